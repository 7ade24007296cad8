"""SimHash near-dedup with BK-trees.

Distinct fingerprints within `radius` bits of each other are linked. The 64 bits are cut
into blocks; two fingerprints that close agree on at least blocks - radius whole blocks,
so the fingerprints that share the value of some choice of blocks form a shard, and all
links lie inside shards. A shard's fingerprints go into a BK-tree (children keyed by their
Hamming distance to the parent); a search follows the edges within the radius only. A
shard gives a spanning set of its links, not its pairs.

Shards are dealt by a shuffle rather than broadcast, as all of them together grow with the
documents. A shard beyond `hot` fingerprints is not gathered: there each fingerprint names
every fingerprint within half the radius of it (65 for a radius of 2), and two that share a name
are linked when they are close enough; no more than that many distinct fingerprints can
share a name, so no group there can grow.

Rows: null and empty texts, and texts without words, have fingerprint zero and are linked
like any other; texts of fewer words than a shingle are one shingle; repeated rows share
their component; rows of a null doc_id are listed with the component of their
fingerprint, null if no row with an id reaches it; extra columns are ignored; an empty table
gives an empty result. A text is held by one task, with a hash for each of its shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components
from .storage import durable

#: fixed value: the seed of a shingle's hash
SEED = 42


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of the bits of unsigned 64-bit hashes; a bit is set if it is in over half of them."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the six white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
    last = (ends - 1).tolist()[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle: int, few: int = 0) -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits.

    Over an even, small number of shingles a majority sets few bits, and unrelated texts come close: two shingles
    give a quarter of the bits. Texts of fewer shingles than `few` therefore get the hash of all their words, so
    that they are near equal ones only.
    """

    def run(batches):
        for b in batches:
            buf, offs = tn.buffer_of(tn.as_bytes(b.column(1)))
            fps = []
            for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                text = buf[a:z].tobytes()
                h = shingle_hashes(text, shingle)
                fps.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED) if 0 < len(h) < few else fingerprint(h))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Values as parallel lists; children of a node by distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Puts the value in; the indexes of the values within the radius that were there before."""
        found = self.search(value, radius)
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                break
            at = nxt
        return found

    def search(self, value: int, radius: int) -> list[int]:
        found, todo, values, children = [], [0] if self.values else [], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if kids := children[at]:
                if len(kids) > 2 * radius:
                    todo += [kids[x] for x in range(d - radius, d + radius + 1) if x in kids]
                else:
                    todo += [kid for x, kid in kids.items() if -radius <= x - d <= radius]
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs of indexes that join the same groups as all pairs within the radius do."""
    tree, links, root = BKTree(), [], list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in tree.add(v, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((i, j))
    return links


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of each choice of blocks - radius blocks: one at least is equal in any two fingerprints that close."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int, blocks: int, hot: int = 4096) -> DataFrame:
    """Distinct fp -> (a, b): links between fingerprints, spanning those of each shard."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius, blocks)])).alias("mask", "value"))
    sizes = shards.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    # written down, as both kinds of shards below read it
    shards = durable(shards.join(sizes, ["mask", "value"]))

    def trees(rows: list[pa.Table], last: bool):
        """Links of the shards that are whole, and what may be the beginning of the next."""
        t = pa.concat_tables(rows)
        mask, value, fp = (t[c].to_numpy() for c in ("mask", "value", "fp"))
        edge = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
        ends = [*edge[1:].tolist(), *[len(fp)] * last]
        unsigned = fp.view(np.uint64).tolist()
        a, b = [], []
        for lo, hi in zip(edge.tolist(), ends, strict=False):
            for i, j in spanning_links(unsigned[lo:hi], radius):
                a.append(fp[lo + i])
                b.append(fp[lo + j])
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"]), t.slice(edge[-1])

    def run(batches):
        open_shard = []
        for b in batches:
            if b.num_rows:
                found, rest = trees([*open_shard, pa.Table.from_batches([b])], False)
                open_shard = [rest]
                yield found
        if open_shard:
            yield trees(open_shard, True)[0]

    cold = shards.where(F.col("n") <= hot).select("mask", "value", "fp").repartition(parts, "mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, "a bigint, b bigint")
    rest = shards.where(F.col("n") > hot)
    return cold.unionByName(_by_names(rest.select("fp").distinct()) if radius == 2 else _in_blocks(rest, radius, hot))


def _by_names(fps: DataFrame) -> DataFrame:
    """Links within two bits: both fingerprints name the one between them. At most 65 fingerprints share a name."""
    near = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    named = fps.select("fp", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("fp")))).alias("name"))
    groups = named.groupBy("name").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return groups.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def _in_blocks(shards: DataFrame, radius: int, size: int) -> DataFrame:
    """Links of shards of any size: each is cut into blocks, and each two blocks are held against each other."""
    cut = shards.withColumn("k", F.ceil(F.col("n") / size)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    pairs = cut.select("mask", "value", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    pairs = pairs.select("mask", "value", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))

    def run(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy()
        left, right = (fp[table[c].to_numpy(zero_copy_only=False)] for c in ("left", "right"))
        close = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= radius
        close[left[:, None] == right[None, :]] = False
        none = len(fp)
        a, b = np.arange(len(left)), np.full(len(right), none)
        while True:  # the smallest left place that each can reach inside these blocks
            new_b = np.minimum(b, np.where(close, a[:, None], none).min(axis=0, initial=none))
            new_a = np.minimum(a, np.where(close, new_b[None, :], none).min(axis=1, initial=none))
            if (new_a == a).all() and (new_b == b).all():
                break
            a, b = new_a, new_b
        f, t = [left[a != np.arange(len(left))], right[b < none]], [left[a[a != np.arange(len(left))]], left[b[b < none]]]
        f, t = np.concatenate(f), np.concatenate(t)
        return pa.table({"a": f[f != t], "b": t[f != t]})

    return pairs.groupBy("mask", "value", "i", "j").applyInArrow(run, "a bigint, b bigint")


def blocks_for(rows: int, radius: int) -> int:
    """Blocks to cut 64 bits into, so that a shard of fingerprints at random has about a thousand at most."""
    blocks = radius + 1
    while rows >> (64 * (blocks - radius) // blocks) > 1024 and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def grouped(docs: DataFrame, shingle: int = 5, radius: int = 6, blocks: int | None = None, few: int = 8, hot: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that links reach."""
    fps = durable(fingerprints(docs, shingle, few))
    blocks = blocks or blocks_for(fps.count(), radius)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(distinct.select("fp"), radius, blocks, hot), distinct.select(F.col("fp").alias("node"), F.col("rep").alias("rank")))
    # written down, so that the join below splits the rows of a fingerprint that many documents have
    by_fp = durable(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("rank")).alias("component_id")))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: three-word shingles, links within two bits."""
    g = grouped(docs, shingle=3, radius=2, few=0)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id. Rows that repeat a kept doc_id are one
    document and stay; so do rows of a null doc_id."""
    g = grouped(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(g.withColumnRenamed("doc_id", "kept_id"), F.col("doc_id") == F.col("kept_id"), "left")
    return kept.where("kept_id is not null or doc_id is null").drop("kept_id")

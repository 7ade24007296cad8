"""Near copies by SimHash fingerprints in BK-trees, and an exact Jaccard similarity of word shingles.

Fingerprints within RADIUS bits of each other, found by the BK-trees of simhash.py, name candidates.
One fingerprint comes that close for part of the pairs at a Jaccard of 0.8 only, so MinHash bands name
the others: of BANDS keys, each over ROWS smallest values, two sets at Jaccard j share one with chance
1 - (1 - j^ROWS)^BANDS, 0.9996 at 0.8 and more above. The sets that either joins, directly or by way
of others, are gathered and all held against each other: only pairs whose shingle sets truly reach
the similarity are linked.

A gathered group beyond `size` is cut into blocks, and each two blocks are held against each
other, so no task holds a large group. A block gives a link for each of its sets; two blocks give
one for each of their own groups that the other joins to more, not one for each set. Equal sets
travel once.

Rows: null and empty texts, and texts without words, have the empty set and are copies of each
other; texts of fewer words than a shingle are one shingle; rows of a null doc_id link others
and are listed, but give no component its id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components, thinned
from .simhash import SEED, blocks_for, fingerprint, links, shingle_hashes
from .storage import durable

#: fixed values: smallest values in a band's key, bands
ROWS, BANDS = 5, 20
#: fixed values: bits that fingerprints of candidates may differ in; sets of fewer shingles come close to unrelated ones and are near equal ones only
RADIUS, FEW = 3, 8
#: least similarity, as a fraction of whole numbers
SIMILAR = (4, 5)
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)[:, None]
_FACTOR = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SLICE = 4096


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def bands(s: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set, as signed longs."""
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for a in range(0, len(s), _SLICE):
        np.minimum(least, ((s[None, a : a + _SLICE] ^ _XOR) * _FACTOR).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = tn.mix(keys ^ column, SEED)
    return keys.view(np.int64)


def _keyed(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, text) -> (doc_id, th, fp, sim, bands): fp is a hash of the whole set, sim its SimHash fingerprint."""

    def run(batches):
        for b in batches:
            buf, offs = tn.buffer_of(tn.as_bytes(b.column(2)))
            fps, sims, keys = [], [], [np.zeros(0, np.int64)]
            for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                s = shingle_set(buf[a:z].tobytes(), shingle)
                fps.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sims.append(fingerprint(s) if len(s) >= FEW else fps[-1])
                keys.append(bands(s))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, sims)), lists], names=["doc_id", "th", "fp", "sim", "bands"])

    return texts.mapInArrow(run, "doc_id bigint, th bigint, fp bigint, sim bigint, bands array<bigint>")


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    owner, column = owner[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # whole numbers under 2^24
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _SLICE):
        a, z = np.searchsorted(column, [lo, lo + _SLICE])
        m = np.zeros((len(sets), _SLICE), dtype=np.float32)
        m[owner[a:z], column[a:z] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def joins(close: np.ndarray) -> np.ndarray:
    """The smallest place that each can reach by a symmetric matrix of links."""
    out = np.arange(len(close))
    while True:
        new = np.minimum(out, np.where(close, out[None, :], len(out)).min(axis=1, initial=len(out)))
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _candidates(rows: DataFrame) -> DataFrame:
    """(node, component) of the sets that fingerprints or bands join with others."""
    once = rows.select("fp", "sim", "bands").dropDuplicates(["fp"])
    sims = durable(once.groupBy("sim").agg(F.min("fp").alias("b")))
    close = links(sims.select(F.col("sim").alias("fp")), RADIUS, blocks_for(sims.count(), RADIUS))
    trees = close.join(sims.withColumnsRenamed({"sim": "a", "b": "fa"}), "a").join(sims.withColumnRenamed("b", "fb"), F.col("b") == F.col("sim")).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    equal = once.join(sims, "sim").select(F.col("fp").alias("a"), "b")
    keys = once.select("fp", F.explode("bands").alias("key"))
    first = keys.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    banded = thinned(keys.join(first, "key").select(F.col("fp").alias("a"), "b"))
    return components(trees.unionByName(equal.where("a <> b")).unionByName(banded))


def _confirmed(groups: DataFrame, shingle: int, size: int) -> DataFrame:
    """(fp, text, component, n) -> (a, b): links of pairs that are similar, spanning those of each two blocks."""
    cut = groups.withColumn("k", F.ceil(F.col("n") / size)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    pairs = cut.select("component", "fp", "text", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    pairs = pairs.select("component", "fp", "text", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    num, den = SIMILAR

    def run(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy()
        left, right = (table[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
        buf, offs = tn.buffer_of(tn.as_bytes(table["text"]))
        sets = [shingle_set(buf[a:z].tobytes(), shingle) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        n, every = np.array([len(s) for s in sets]), np.arange(len(sets))
        close = (den + num) * common(sets, every, every) >= num * (n[:, None] + n[None, :])
        # what a block's own links join comes from its pair with itself
        same = (left[:, None] == left[None, :]) & (~(left & right))[:, None]
        own, joined = joins(close & same), joins(close)
        new = np.flatnonzero((own == every) & (joined != every))
        return pa.table({"a": fp[new], "b": fp[joined[new]]})

    return pairs.groupBy("component", "i", "j").applyInArrow(run, "a bigint, b bigint")


def grouped(docs: DataFrame, shingle: int = 5, size: int = 512) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that links reach."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    rows = durable(_keyed(texts, shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("th").alias("th"))
    candidates = durable(_candidates(rows))
    # written down, so that the join below splits a large component's rows
    sizes = durable(candidates.groupBy("component").agg(F.count("*").alias("n")))
    wanted = candidates.join(sizes, "component").join(distinct, F.col("node") == F.col("fp")).select("th", "fp", "component", "n")
    once = texts.groupBy("th").agg(F.first("text").alias("text"))
    found = components(durable(_confirmed(wanted.join(once, "th").drop("th"), shingle, size)), distinct.select(F.col("fp").alias("node"), F.col("rep").alias("rank")))
    # written down, so that the join below splits the rows of a set that many documents have
    by_fp = durable(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("rank")).alias("component_id")))
    return rows.select("doc_id", "fp").join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id. Rows that repeat a kept doc_id are one
    document and stay; so do rows of a null doc_id."""
    g = grouped(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(g.withColumnRenamed("doc_id", "kept_id"), F.col("doc_id") == F.col("kept_id"), "left")
    return kept.where("kept_id is not null or doc_id is null").drop("kept_id")

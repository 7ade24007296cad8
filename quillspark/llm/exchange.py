"""Ask-and-answer rounds between chunks of documents and buckets of hashes.

A chunk is the documents of one residue of a hash of id and text, about 8 MB of text. It asks
about the distinct hashes it holds: sorted, packed, one part for each bucket (a range of
hash values). A bucket answers each chunk with a packed array in the order of its keys,
and the chunk, which can make the same sorted keys again, reads the answers by position.

How parts travel. A row carries the parts for one range of buckets, and a sender makes at
most FAN rows. With up to FAN buckets a range is one bucket. Beyond, parts go in hops, as in
a radix sort: a relay takes the rows of so many senders for one range, and passes their parts on
in one row for each of as many smaller ranges; answers come back the same way. The hops have
equal steps, the n-th root of the number of buckets for n hops, so a relay gets about what a
chunk sends, not the many times that of a full first step and a short last one. Rows in a hop are
at most FAN for each chunk, and hops are the logarithm of the number of buckets, so rows grow
in proportion to the input, not with chunks times buckets.

A hash that stands in a third of all documents is one key for each chunk, so no bucket
and no shuffle grows with a hot key; nothing is collected, and each round moves a few
bytes for each distinct hash of a chunk. All stages can be run again after a loss: what a
chunk sends depends on its set of rows only, not on their order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import release

CHUNK_BYTES = 8 << 20
#: most rows that a chunk, a relay or a bucket sends in one hop: one hop for 16 GB of text
FAN = 2048
#: no document's column has this name
CHUNK = "__chunk__"
PACKED = "c int, b int, data binary"
_PACKED_ARROW = pa.schema([("c", pa.int32()), ("b", pa.int32()), ("data", pa.binary())])
#: (chunk, kind, bucket, keys, data)
Part = tuple[int, int, int, int, bytes]


@dataclass(frozen=True)
class Route:
    """Numbers of chunks and buckets, and the hops between them."""

    chunks: int
    buckets: int
    fan: int = FAN

    @property
    def hops(self) -> int:
        n, most = 1, max(self.chunks, self.buckets)
        while self.fan**n < most:
            n += 1
        return n

    @property
    def far(self) -> int:
        """How many chunks a row to or from a bucket speaks for, and how many buckets a row from or to a chunk."""
        return self.fan ** (self.hops - 1)


def even_fan(most: int) -> int:
    """The least fan that reaches `most` in as many hops as FAN does."""
    hops, fan = Route(most, most, FAN).hops, 1
    while fan**hops < most:
        fan += 1
    return fan


def route(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Route:
    """Chunks and buckets, each for about chunk_bytes of text, and one for each shuffle partition at least."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    by_bytes = -(-int(total) // chunk_bytes)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, by_bytes)
    return Route(n, n, even_fan(n))


def chunked(docs: DataFrame, count: int) -> DataFrame:
    """docs with a column CHUNK in front, by id and text: rows of one id, or none, spread by their texts."""
    return docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(count)).cast("int").alias(CHUNK), *[F.col(f"`{c}`") for c in docs.columns])


def planes(values: np.ndarray, size: int) -> bytes:
    """The `size` highest bytes of each 64-bit value, byte by byte position: sorted values then compress well."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def from_planes(data: bytes | memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def small(values: np.ndarray, size: int) -> bytes:
    """The `size` lowest bytes of each value, by byte position."""
    return np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - size :].T.tobytes()


def from_small(data: bytes | memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, 8 - size :] = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def bucket_bounds(keys: np.ndarray, count: int) -> np.ndarray:
    """Sorted keys' bounds (count + 1 of them) by bucket: bucket b holds the b-th share of all hash values."""
    edges = [-(-(b << 64) // count) for b in range(1, count)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64), "left"), [len(keys)]])


def asks(chunk: int, kind: int, bounds: np.ndarray, pack) -> list[Part]:
    """A part for each bucket that has keys; pack(lo, hi) makes its data."""
    some = np.flatnonzero(np.diff(bounds))
    return [(chunk, kind, b, hi - lo, pack(lo, hi)) for b, lo, hi in zip(some.tolist(), bounds[some].tolist(), bounds[some + 1].tolist(), strict=True)]


def packed(parts: list[Part]) -> bytes:
    """Parts as one cell: their number, a row of five numbers for each, their data."""
    head = np.array([(c, k, b, n, len(d)) for c, k, b, n, d in parts], dtype="<i4").reshape(-1, 5)
    return b"".join([len(parts).to_bytes(4, "little"), head.tobytes(), *(d for *_, d in parts)])


def unpacked(cells: Iterable[pa.Scalar]) -> list[Part]:
    out: list[Part] = []
    for cell in cells:
        data = memoryview(cell.as_buffer())
        n = int.from_bytes(data[:4], "little")
        head, at = np.frombuffer(data, "<i4", 5 * n, 4).reshape(n, 5).tolist(), 4 + 20 * n
        for c, k, b, keys, size in head:
            out.append((c, k, b, keys, data[at : at + size]))
            at += size
    return out


def rows_of(parts: list[Part], c_range: int, b_range: int) -> pa.Table:
    """Parts as a row for each range of chunks and of buckets."""
    cells: dict[tuple[int, int], list[Part]] = {}
    for p in parts:
        cells.setdefault((p[0] // c_range, p[2] // b_range), []).append(p)
    keys = sorted(cells)
    columns = [[c for c, _ in keys], [b for _, b in keys], [packed(cells[k]) for k in keys]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def asked(parts: list[Part], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(chunk, n, data) of a bucket's parts of one kind, by chunk."""
    for c, _, _, n, data in sorted((p for p in parts if p[1] == kind), key=lambda p: p[0]):
        yield c, n, data


def each_answer(parts: list[Part], kind: int) -> Iterator[bytes]:
    """A chunk's answers of one kind, by bucket."""
    return (p[4] for p in sorted((p for p in parts if p[1] == kind), key=lambda p: p[2]))


def answers(parts: list[Part], kind: int) -> bytes:
    """A chunk's answers of one kind, all buckets in order."""
    return b"".join(each_answer(parts, kind))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the keys' sorting order, and where each distinct key begins in it."""
    order = np.argsort(keys)
    s = keys[order]
    return order, np.flatnonzero(np.concatenate([[len(s) > 0], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def spread(order: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each group's value at each of its members' places."""
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = np.repeat(values, np.diff(np.concatenate([starts, [len(order)]])))
    return out


def released(table: pa.Table) -> pa.Table:
    """The table, after what making it took was given back."""
    release()
    return table


def _relayed(rows: DataFrame, by: list, c_range: int, b_range: int) -> DataFrame:
    def run(table):
        return released(rows_of(unpacked(table["data"]), c_range, b_range))

    return rows.groupBy(*by).applyInArrow(run, PACKED)


def _to_buckets(rows: DataFrame, r: Route) -> DataFrame:
    """Rows from chunks, with parts of one bucket each."""
    for k in range(1, r.hops):
        rows = _relayed(rows, [F.floor(F.col("c") / r.fan).alias("to"), "b"], r.fan**k, r.fan ** (r.hops - 1 - k))
    return rows


def _to_chunks(rows: DataFrame, r: Route) -> DataFrame:
    """Rows from buckets, with parts for one chunk each."""
    for k in range(r.hops - 1, 0, -1):
        rows = _relayed(rows, ["c", F.floor(F.col("b") / r.fan).alias("from")], r.fan ** (k - 1), r.fan ** (r.hops - k))
    return rows


def chunk_asks(docs: DataFrame, r: Route, f) -> DataFrame:
    """f(chunk number, documents of the chunk as a table) -> parts, as asks() makes them."""

    def run(key, table):
        return released(rows_of(f(key[0].as_py(), table.drop_columns(CHUNK)), 1, r.far))

    return docs.groupBy(CHUNK).applyInArrow(run, PACKED)


def by_bucket(asking: DataFrame, r: Route, f, schema: str = PACKED) -> DataFrame:
    """f(bucket, its parts) -> table."""

    def run(key, table):
        return released(f(key[0].as_py(), unpacked(table["data"])))

    return _to_buckets(asking, r).groupBy("b").applyInArrow(run, schema)


def bucket_asks(asking: DataFrame, r: Route, f) -> DataFrame:
    """f(bucket, its parts) -> parts to other buckets, in which this bucket stands for a chunk."""
    return by_bucket(asking, r, lambda b, parts: rows_of(f(b, parts), 1, r.far))


def bucket_answers(asking: DataFrame, r: Route, f) -> DataFrame:
    """f(bucket, its parts) -> parts, each to the chunk that it names."""
    return by_bucket(asking, r, lambda b, parts: rows_of(f(b, parts), r.far, 1))


def with_answers(docs: DataFrame, answered: DataFrame, r: Route, f, schema: str, more: DataFrame | None = None) -> DataFrame:
    """f(chunk number, documents of the chunk, its answers) -> table. more: rows with parts for one chunk each."""

    def run(key, left, right):
        return released(f(key[0].as_py(), left.drop_columns(CHUNK), unpacked(right["data"])))

    found = _to_chunks(answered, r)
    found = found if more is None else found.unionByName(more)
    return docs.groupBy(CHUNK).cogroup(found.groupBy("c")).applyInArrow(run, schema)


def chunk_asks_again(docs: DataFrame, answered: DataFrame, r: Route, f) -> DataFrame:
    return with_answers(docs, answered, r, lambda chunk, left, right: rows_of(f(chunk, left, right), 1, r.far), PACKED)

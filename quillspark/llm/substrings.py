"""Substring dedup with fixed-block anchors.

Every document is a reference: its words are cut into non-overlapping blocks of seven,
and the blocks' hashes are indexed. Every rolling window of seven words probes the index;
a run of 13 words always holds a whole block of its counterpart, so a run that recurs is
never missed. Hits are extended to runs of 13 words, told apart by the hash of the whole
run and settled by the smallest doc_id that holds it; adjoining runs make up the maximal
exact repeats. Index and probes meet in buckets of hash values (see exchange), a distinct
hash once for each chunk, so that a passage in a third of all documents weighs no more
than any other.

Block hashes carry 40 bits, which only widens the candidates. Runs are told apart by 64
bits: over n distinct runs the chance of any mistake is about n^2 / 2^65.

Rows: null and empty texts have no words; a null doc_id counts as larger than all others;
rows of equal doc_id never dedupe each other; extra columns pass through repeats() as
they are, but for n_words and n_removed, which it returns itself; an empty table gives an
empty result. A text is held by one task, and rows equal in doc_id and text by the same one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textnum as tn

#: fixed values: words of a run, and the longest block that any placement of a run holds whole
RUN, BLOCK = 13, 7
_SCREEN = 5  # bytes of a block's hash that are sent
_NO_ID = np.iinfo(np.int64).max


class _Chunk:
    """Words of a chunk's documents."""

    def __init__(self, table: pa.Table):
        self.text = tn.as_bytes(table["text"])
        ids = table["doc_id"].combine_chunks().cast(pa.int64())
        self.ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        hashes, rows = [], []
        for lo, _, buf, offs in tn.chunks(self.text):
            s, e, r = tn.spans(buf, offs, tn.SPACE)
            hashes.append(tn.SubstringHash(buf)(s, e))
            rows.append(r + lo)
        self.words = np.concatenate([np.zeros(0, tn.U64), *hashes])
        self.rows = np.concatenate([np.zeros(0, np.int64), *rows])

    def inside(self, size: int) -> np.ndarray:
        """Starts of the windows of `size` words that lie in one document."""
        n = len(self.words) - size + 1
        return np.flatnonzero(self.rows[:n] == self.rows[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rolling block windows: starts, screened hashes, and which are index blocks."""
        at = self.inside(BLOCK)
        h = tn.windows(self.words, BLOCK)[at] & tn.U64((1 << 64) - (1 << 8 * (8 - _SCREEN)))
        first = tn.first_of_rows(self.rows, len(self.ids))
        return at, h, (at - first[self.rows[at]]) % BLOCK == 0

    def candidates(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs that hold a block that was hit (hits: starts of such blocks)."""
        mark = np.zeros(len(self.words) + 1, dtype=np.int64)
        mark[hits + 1] = 1
        mark = np.cumsum(mark)
        runs = self.inside(RUN)
        runs = runs[mark[runs + RUN - BLOCK + 1] > mark[runs]]
        return runs, tn.windows(self.words, RUN, 1)[runs]


def _ask_blocks(chunk: int, table: pa.Table, buckets: int) -> list[ex.Part]:
    _, h, block = _Chunk(table).probes()
    order, starts = ex.groups(h)
    keys = h[order][starts]
    flags = np.minimum(np.diff(np.concatenate([starts, [len(h)]])), 2) + 4 * (np.maximum.reduceat(block[order], starts) if len(starts) else 0)
    return ex.asks(chunk, 0, ex.bucket_bounds(keys, buckets), lambda lo, hi: ex.planes(keys[lo:hi], _SCREEN) + flags[lo:hi].astype(np.uint8).tobytes())


def _answer_blocks(bucket: int, asking: list[ex.Part]) -> list[ex.Part]:
    parts = [(c, n, ex.from_planes(d, n, _SCREEN), np.frombuffer(d, np.uint8)[n * _SCREEN :]) for c, n, d in ex.asked(asking, 0)]
    keys, flags = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order, starts = ex.groups(keys)
    hit = (np.add.reduceat((flags & 3)[order].astype(np.int64), starts) > 1) & (np.maximum.reduceat(flags[order], starts) >= 4)
    hit = ex.spread(order, starts, hit)
    return _by_chunk(parts, hit, 0, bucket)


def _by_chunk(parts, values: np.ndarray, kind: int, bucket: int) -> list[ex.Part]:
    out, at = [], 0
    for p in parts:
        out.append((p[0], kind, bucket, p[1], values[at : at + p[1]].astype(np.uint8).tobytes()))
        at += p[1]
    return out


def _runs(c: _Chunk, answers: list[ex.Part]):
    """Candidate runs: starts, hashes, their sorting, distinct hashes and the smallest id of each."""
    at, h, _ = c.probes()
    at, h = c.candidates(at[ex.spread(*ex.groups(h), np.frombuffer(ex.answers(answers, 0), np.uint8)) > 0])
    order, starts = ex.groups(h)
    ids = c.ids[c.rows[at]]
    least = np.minimum.reduceat(ids[order], starts) if len(starts) else np.zeros(0, np.int64)
    return at, h[order][starts], order, starts, ids, least


def _ask_runs(chunk: int, table: pa.Table, answers: list[ex.Part], buckets: int) -> list[ex.Part]:
    _, keys, _, _, _, least = _runs(_Chunk(table), answers)
    # ids as offset binary, so that their bytes sort and small ids compress
    return ex.asks(chunk, 1, ex.bucket_bounds(keys, buckets), lambda lo, hi: ex.planes(keys[lo:hi], 8) + ex.small(least[lo:hi].view(np.uint64), 8))


def _answer_runs(bucket: int, asking: list[ex.Part]) -> list[ex.Part]:
    parts = [(c, n, ex.from_planes(d[: 8 * n], n, 8), ex.from_small(d[8 * n :], n, 8).view(np.int64)) for c, n, d in ex.asked(asking, 1)]
    keys, least = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order, starts = ex.groups(keys)
    smallest = ex.spread(order, starts, np.minimum.reduceat(least[order], starts))
    return _by_chunk(parts, smallest < least, 1, bucket)


def _removed(c: _Chunk, answers: list[ex.Part]) -> np.ndarray:
    """For each word of the chunk: is it covered by a run that a smaller doc_id holds?"""
    at, _, order, starts, ids, least = _runs(c, answers)
    earlier = np.frombuffer(ex.answers(answers, 1), np.uint8).astype(bool)
    again = ex.spread(order, starts, earlier) | (ids > ex.spread(order, starts, least)) if len(at) else np.zeros(0, bool)
    return tn.cover(at[again], RUN, len(c.words))


def _kept(c: _Chunk, gone: np.ndarray):
    """For each document: words, words removed, kept words joined by a space."""
    first = 0
    for _, _, buf, offs in tn.chunks(c.text):
        s, e, r = tn.spans(buf, offs, tn.SPACE)
        data, bounds = buf.tobytes(), tn.first_of_rows(r, len(offs) - 1).tolist()
        s, e = s.tolist(), e.tolist()
        drop = gone[first : first + len(s)]
        first += len(s)
        lost = tn.sums(drop, np.asarray(bounds)).tolist()
        drop = drop.tolist()
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if lost[k]:
                yield hi - lo, lost[k], b" ".join([data[s[i] : e[i]] for i in range(lo, hi) if not drop[i]])
            else:
                yield hi - lo, 0, b" ".join(data[offs[k] : offs[k + 1]].split())


def _finish(docs: DataFrame, make, schema: str) -> DataFrame:
    r = ex.route(docs)
    chunks = ex.chunked(docs, r.chunks)
    hits = ex.bucket_answers(ex.chunk_asks(chunks, r, lambda c, t: _ask_blocks(c, t, r.buckets)), r, _answer_blocks)
    found = ex.bucket_answers(ex.chunk_asks_again(chunks, hits, r, lambda c, t, a: _ask_runs(c, t, a, r.buckets)), r, _answer_runs)
    return ex.with_answers(chunks, hits.unionByName(found), r, lambda c, t, a: make(t, a), schema)


def repeats(docs: DataFrame) -> DataFrame:
    """docs with text replaced by its kept words (joined by a space; unchanged where none is removed),
    and n_words, n_removed."""
    names = [f.name for f in docs.schema if f.name not in ("n_words", "n_removed")]
    docs = docs.select(*[F.col(f"`{n}`") for n in names])

    def make(table, answers):
        c = _Chunk(table)
        kept = list(_kept(c, _removed(c, answers)))
        texts = [k.decode(errors="replace") if lost else t for (_, lost, k), t in zip(kept, table["text"].to_pylist(), strict=True)]
        cols = [pa.array(texts, pa.string()) if n == "text" else table[n] for n in names]
        return pa.table([*cols, pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=[*names, "n_words", "n_removed"])

    return _finish(docs, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint, n_removed bigint"]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def make(table, answers):
        c = _Chunk(table)
        kept = [(n, lost, hashlib.sha256(k).hexdigest()) for n, lost, k in _kept(c, _removed(c, answers))]
        cols = [pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table([table["doc_id"], *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _finish(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")

"""Suffix-array dedup of strings of 200 bytes, by deep-shallow sorting.

Which suffixes meet: each string of 200 bytes is dealt by its anchor, the 48-byte piece
inside it with the smallest hash (leftmost if tied). The anchor depends on the string's
bytes alone, so equal strings meet, and about 75 neighbouring strings share an anchor and
travel as one stretch of text. Strings whose anchor stands once only can't recur.

How they are told apart: the stretches of a bucket are sorted twice by deep-shallow
sorting (see deepshallow), as suffixes that begin at the anchor and as reversed prefixes
that end there. Their common prefixes say, for each offset, which stretches agree over
the bytes left of the anchor and which right of it; a string recurs where another
stretch, or a copy of its own, agrees on both sides. The comparison is of bytes.

A chunk sends equal stretches once, with a mark that it has several. An anchor with very
many different stretches (the edge of a passage that a third of all documents share) is
not gathered: its strings are dealt by a 64-bit hash of their own bytes instead.

Rows: null texts are empty; texts under 200 bytes lose nothing but are listed; repeated
rows are copies of each other; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deepshallow
from . import exchange as ex
from . import textnum as tn

#: fixed values: length of a string, of an anchor
LENGTH, ANCHOR = 200, 48
SPAN = LENGTH - ANCHOR + 1  # places of the anchor in a string
#: an anchor with more different stretches than this (each chunk's own counted) is not gathered
HOT = 20_000
_SCREEN = 5
_SLICE = 1 << 22
_PLACE = tn.U64((1 << 24) - 1)


class _Part:
    """Stretches of a run of documents: strings that follow each other and share an anchor."""

    def __init__(self, lo: int, buf: np.ndarray, offs: np.ndarray):
        self.lo, self.buf, self.offs = lo, buf, offs
        found = []
        self.anchor_hash = self.first = self.last = self.anchor = np.zeros(0, np.int64)
        if len(buf) < LENGTH:
            self.anchor_hash = np.zeros(0, tn.U64)
            return
        self.hash = tn.SubstringHash(buf)
        for a in range(0, len(buf) - LENGTH + 1, _SLICE):
            z = min(a + _SLICE + LENGTH - 1, len(buf))
            at = np.arange(a, z - ANCHOR + 1)
            least = (self.hash(at, at + ANCHOR) & ~_PLACE) | (at - a).astype(tn.U64)
            m, width = least, 1
            while width * 2 <= SPAN:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            m = np.minimum(m[: len(least) - SPAN + 1], m[SPAN - width :][: len(least) - SPAN + 1])
            found.append((m & _PLACE).astype(np.int64) + a)
        anchor = np.concatenate(found)
        room = offs[1:] - LENGTH  # last string of each row
        row = np.searchsorted(offs, np.arange(len(anchor)), "right") - 1
        valid = np.arange(len(anchor)) <= room[row]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]) & (row[1:] == row[:-1]))
        self.first = np.flatnonzero(new)
        end = valid.copy()
        end[:-1] &= ~(valid[1:] & (anchor[1:] == anchor[:-1]) & (row[1:] == row[:-1]))
        self.last = np.flatnonzero(end)
        self.anchor = anchor[self.first]
        # anchors are smallest hashes, so mixed again to spread over the buckets
        self.anchor_hash = tn.mix(self.hash(self.anchor, self.anchor + ANCHOR), 0x3C6EF372)

    def identity(self, which: np.ndarray) -> np.ndarray:
        """Hash of the whole stretch."""
        return self.hash(self.first[which], self.last[which] + LENGTH)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every string of the stretches."""
        n = self.last[which] - self.first[which] + 1
        at = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        h = tn.mix(self.hash(at, at + LENGTH), 0x51ED270B) if len(at) else np.zeros(0, tn.U64)
        return at, h


def _parts(table: pa.Table):
    for lo, _, buf, offs in tn.chunks(tn.as_bytes(table["text"])):
        yield _Part(lo, buf, offs)


def _cut(h: np.ndarray) -> np.ndarray:
    return h & tn.U64((1 << 64) - (1 << 8 * (8 - _SCREEN)))


def _ask_anchors(chunk: int, table: pa.Table, buckets: int) -> list[ex.Part]:
    """Distinct anchors, each with its number of different stretches and whether it stands more than once."""
    got = [(p.anchor_hash, p.identity(slice(None))) for p in _parts(table) if len(p.first)]
    if not got:
        return []
    a, whole = _cut(np.concatenate([g[0] for g in got])), np.concatenate([g[1] for g in got])
    order = np.lexsort((whole, a))
    a, whole = a[order], whole[order]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    starts = np.flatnonzero(new)
    different = np.add.reduceat((new | np.concatenate([[True], whole[1:] != whole[:-1]])).astype(np.int64), starts)
    several = np.diff(np.concatenate([starts, [len(a)]])) > 1
    keys, value = a[starts], np.minimum(different, 0x7FFF) * 2 + several
    return ex.asks(chunk, 0, ex.bucket_bounds(keys, buckets), lambda lo, hi: ex.planes(keys[lo:hi], _SCREEN) + ex.small(value[lo:hi], 2))


def _answer_anchors(bucket: int, asking: list[ex.Part], hot: int) -> list[ex.Part]:
    """0: stands once; 1: recurs; 2: recurs with very many different stretches."""
    parts = [(c, n, ex.from_planes(d, n, _SCREEN), ex.from_small(d[n * _SCREEN :], n, 2)) for c, n, d in ex.asked(asking, 0)]
    keys, value = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64)
    order, starts = ex.groups(keys)
    different = np.add.reduceat(value[order] >> 1, starts)
    recurs = (np.diff(np.concatenate([starts, [len(keys)]])) > 1) | (np.maximum.reduceat(value[order] & 1, starts) > 0)
    verdict = ex.spread(order, starts, recurs.astype(np.uint8) + (recurs & (different > hot)))
    out, at = [], 0
    for c, n, *_ in parts:
        out.append((c, 0, bucket, n, verdict[at : at + n].astype(np.uint8).tobytes()))
        at += n
    return out


class _Chunk:
    """A chunk's stretches that recur by anchor, and the strings of its hot anchors."""

    def __init__(self, table: pa.Table, answers: list[ex.Part]):
        self.parts = list(_parts(table))
        keys = np.concatenate([np.zeros(0, tn.U64), *(_cut(p.anchor_hash) for p in self.parts)])
        verdict = ex.spread(*ex.groups(keys), np.frombuffer(ex.answers(answers, 0), np.uint8))
        verdicts = np.split(verdict, np.cumsum([len(p.first) for p in self.parts]))
        self.cold, self.strings = [], []  # by part: which stretches; (start, hash) of strings
        a, whole = [np.zeros(0, tn.U64)], [np.zeros(0, tn.U64)]
        for p, v in zip(self.parts, verdicts, strict=False):
            which = np.flatnonzero(v == 1)
            self.cold.append(which)
            if len(which):
                a.append(p.anchor_hash[which])
                whole.append(p.identity(which))
            hot = np.flatnonzero(v == 2)
            self.strings.append(p.strings(hot) if len(hot) else (np.zeros(0, np.int64), np.zeros(0, tn.U64)))
        self.anchor, whole = np.concatenate(a), np.concatenate(whole)
        self.order = np.lexsort((whole, self.anchor))
        s, w = self.anchor[self.order], whole[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])])) if len(s) else np.zeros(0, np.int64)
        self.part = np.repeat(np.arange(len(self.parts)), [len(c) for c in self.cold])
        self.stretch = np.concatenate([np.zeros(0, np.int64), *self.cold])
        self.string_order, self.string_starts = ex.groups(np.concatenate([np.zeros(0, tn.U64), *(h for _, h in self.strings)]))

    def sizes(self, members: np.ndarray) -> np.ndarray:
        """Strings of each stretch (by place in self.stretch)."""
        out = np.zeros(len(members), dtype=np.int64)
        for k, p in enumerate(self.parts):
            m = self.part[members] == k
            out[m] = (p.last - p.first + 1)[self.stretch[members[m]]]
        return out


def _ask_stretches(chunk: int, table: pa.Table, answers: list[ex.Part], buckets: int) -> list[ex.Part]:
    c = _Chunk(table, answers)
    chosen = c.order[c.starts]
    several = np.diff(np.concatenate([c.starts, [len(c.order)]])) > 1
    keys, texts = c.anchor[chosen], [b""] * len(chosen)
    left, count = np.zeros(len(chosen), np.int64), c.sizes(chosen)
    for k, p in enumerate(c.parts):
        data = None
        for i in np.flatnonzero(c.part[chosen] == k).tolist():
            data = p.buf.tobytes() if data is None else data
            s = c.stretch[chosen[i]]
            texts[i] = data[p.first[s] : p.last[s] + LENGTH]
            left[i] = p.anchor[s] - p.first[s]

    def pack(lo, hi):
        return ex.planes(keys[lo:hi], 8) + ex.small(left[lo:hi], 1) + ex.small(count[lo:hi], 1) + ex.small(several[lo:hi], 1) + b"".join(texts[lo:hi])

    rows = ex.asks(chunk, 1, ex.bucket_bounds(keys, buckets), pack)
    h = np.concatenate([np.zeros(0, tn.U64), *(h for _, h in c.strings)])[c.string_order][c.string_starts]
    often = np.diff(np.concatenate([c.string_starts, [len(c.string_order)]])) > 1
    return rows + ex.asks(chunk, 2, ex.bucket_bounds(h, buckets), lambda lo, hi: ex.planes(h[lo:hi], 8) + ex.small(often[lo:hi], 1))


def recurring(anchor: np.ndarray, left: np.ndarray, count: np.ndarray, several: np.ndarray, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For stretches sorted by anchor: a row of SPAN booleans each, does the string that begins
    `offset` bytes before the anchor recur? (Offsets a stretch has no string for: False.)"""
    n = len(anchor)
    size = count + LENGTH - 1
    # prefixes reversed, up to the anchor
    mirrored = buf[::-1]
    by_left, shared_left = deepshallow.sort(mirrored, len(buf) - (starts + left), left, anchor)
    by_right, shared_right = deepshallow.sort(buf, starts + left, np.minimum(size - left, LENGTH), anchor)
    out = np.zeros((n, SPAN), dtype=bool)
    cl, cr = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(SPAN):
        has = np.flatnonzero((offset <= left) & (offset > left - count))
        if not len(has):
            continue
        cl[by_left] = np.cumsum(shared_left < offset)
        cr[by_right] = np.cumsum(shared_right < LENGTH - offset)
        key = cl[has] * (n + 1) + cr[has]
        order, first = ex.groups(key)
        again = (np.diff(np.concatenate([first, [len(key)]])) > 1) | (np.maximum.reduceat(several[has][order].astype(np.int8), first) > 0)
        out[has, offset] = ex.spread(order, first, again)
    return out


def _answer_stretches(bucket: int, asking: list[ex.Part]) -> list[ex.Part]:
    out = []
    parts = []
    for c, n, d in ex.asked(asking, 1):
        parts.append((c, n, ex.from_planes(d, n, 8), *(ex.from_small(d[n * k :], n, 1).astype(np.int64) for k in (8, 9, 10)), np.frombuffer(d, np.uint8)[11 * n :]))
    if parts:
        anchor, left, count, several = (np.concatenate([p[k] for p in parts]) for k in range(2, 6))
        buf = np.concatenate([p[6] for p in parts])
        starts = np.concatenate([[0], np.cumsum(count + LENGTH - 1)[:-1]])
        # an anchor of one stretch needs no sorting
        order, first = ex.groups(anchor)
        alone = ex.spread(order, first, np.diff(np.concatenate([first, [len(anchor)]])) == 1)
        found = np.zeros((len(anchor), SPAN), dtype=bool)
        found[alone & (several > 0)] = True
        rest = order[~alone[order]]
        if len(rest):
            found[rest] = recurring(anchor[rest], left[rest], count[rest], several[rest], buf, starts[rest])
        at = 0
        for c, n, *_ in parts:
            f, lf, ct = found[at : at + n], left[at : at + n], count[at : at + n]
            # strings in the order of their starts: offsets from `left` down
            row = np.repeat(np.arange(n), ct)
            offset = np.repeat(lf, ct) - (np.arange(ct.sum()) - np.repeat(np.concatenate([[0], np.cumsum(ct)[:-1]]), ct))
            # padded to whole bytes for each bucket, so a length goes along
            bits = f[row, offset]
            out.append((c, 1, bucket, n, len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes()))
            at += n
    parts = [(c, n, ex.from_planes(d, n, 8), np.frombuffer(d, np.uint8)[8 * n :]) for c, n, d in ex.asked(asking, 2)]
    if parts:
        keys, often = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        order, first = ex.groups(keys)
        again = ex.spread(order, first, (np.diff(np.concatenate([first, [len(keys)]])) > 1) | (np.maximum.reduceat(often[order], first) > 0))
        at = 0
        for c, n, *_ in parts:
            out.append((c, 2, bucket, n, again[at : at + n].astype(np.uint8).tobytes()))
            at += n
    return out


def _bits(answers: list[ex.Part]) -> np.ndarray:
    out = [np.zeros(0, bool)]
    for d in ex.each_answer(answers, 1):
        n = int.from_bytes(d[:4], "little")
        out.append(np.unpackbits(np.frombuffer(d, np.uint8)[4:], count=n).astype(bool))
    return np.concatenate(out)


def covered(table: pa.Table, answers: list[ex.Part]):
    """For each run of rows: (first row, bytes, offsets, which bytes a recurring string covers)."""
    c = _Chunk(table, answers)
    starts_by_part: list[list[np.ndarray]] = [[] for _ in c.parts]
    if len(c.order):
        bits = _bits(answers)
        sizes = c.sizes(c.order[c.starts])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mine = ex.spread(c.order, c.starts, at)  # where each stretch's answers begin
        for k, p in enumerate(c.parts):
            m = np.flatnonzero(c.part == k)
            s = c.stretch[m]
            n = (p.last - p.first + 1)[s]
            step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
            yes = bits[np.repeat(mine[m], n) + step]
            starts_by_part[k].append((np.repeat(p.first[s], n) + step)[yes])
    if len(c.string_order):
        again = ex.spread(c.string_order, c.string_starts, np.frombuffer(ex.answers(answers, 2), np.uint8).astype(bool))
        at = 0
        for k, (s, _) in enumerate(c.strings):
            starts_by_part[k].append(s[again[at : at + len(s)]])
            at += len(s)
    for p, found in zip(c.parts, starts_by_part, strict=True):
        yield p.lo, p.buf, p.offs, tn.cover(np.concatenate([np.zeros(0, np.int64), *found]), LENGTH, len(p.buf))


def _finish(docs: DataFrame, make, schema: str, hot: int) -> DataFrame:
    r = ex.route(docs)
    chunks = ex.chunked(docs, r.chunks)
    anchors = ex.bucket_answers(ex.chunk_asks(chunks, r, lambda c, t: _ask_anchors(c, t, r.buckets)), r, lambda b, p: _answer_anchors(b, p, hot))
    found = ex.bucket_answers(ex.chunk_asks_again(chunks, anchors, r, lambda c, t, a: _ask_stretches(c, t, a, r.buckets)), r, _answer_stretches)
    return ex.with_answers(chunks, anchors.unionByName(found), r, lambda c, t, a: make(t, a), schema)


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (array of [start, end) byte runs removed)."""
    return _removed(docs, hot, False)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _removed(docs, hot, True)


def _removed(docs: DataFrame, hot: int, digest: bool) -> DataFrame:
    def make(table, answers):
        out: list[tuple] = []
        for _, buf, offs, gone in covered(table, answers):
            lost = tn.sums(gone, offs).tolist()
            for k, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                if not lost[k]:
                    kept, begins, ends = buf[a:z].tobytes(), (), ()
                else:
                    g = gone[a:z]
                    kept = buf[a:z][~g].tobytes()
                    edge = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
                    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                if digest:
                    out.append((z - a, lost[k], len(begins), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((z - a, kept, [{"s": int(s), "e": int(e)} for s, e in zip(begins, ends, strict=True)]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["n_bytes", "kept", "spans"]
        return pa.table([table["doc_id"], *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if digest else "n_bytes bigint, kept binary, spans array<struct<s:bigint,e:bigint>>"
    return _finish(docs.select("doc_id", F.col("text")), make, f"doc_id {kind}, {rest}", hot)

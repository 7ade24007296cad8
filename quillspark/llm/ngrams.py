"""Interpolated modified Kneser-Ney language model of word pairs, counted in Spark.

Counting and scoring share one round trip (see exchange). A chunk of documents asks for
its distinct word pairs, giving the training counts it has of each; a bucket of pairs adds
the counts up into sorted hash arrays, which its worker maps into memory from a file, and
answers by binary search in them. What the smoothing needs of words (how many pairs
a word begins once, twice, more often; how many different words it follows) goes from
there to buckets of words, which hold the words' counts in the same way. The discounts come
from the counts of counts over all buckets. The model lies nowhere in full: a
task holds one bucket's arrays, whatever the corpus.

A text's probability is the product over its tokens, words and one end, of
  p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v) p(w)
where p(w) discounts the number of words that w follows in the same way and gives what is
left over evenly to all training words and one unseen word.

Words are told apart by 64-bit hashes, in pairs by the highest 40 bits of them.

Rows: null and empty texts are one end token; a null doc_id counts as the empty id text;
repeated rows are counted each; without training tokens every word is unseen; an empty
table gives an empty result.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textnum as tn
from .storage import shared_folder
from .textnum import release

CHUNK_BYTES = 12 << 20
#: fixed values: the end token and the beginning that no text can hold
END, BEGIN = tn.U64(0x9D39247E33776D41), tn.U64(0x2AF7398005AAA5C7)
_ID = 5  # bytes of a word's hash in pairs
_SUM = 6  # bytes of a count over all chunks
_LOW = tn.U64((1 << 64) - (1 << 8 * (8 - _ID)))
PAIRS, WORDS, PARTS, COUNTS, TOTALS = range(5)  # kinds of rows


def held_out(doc_id: Column) -> Column:
    """Rows that the model doesn't learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def mounted(folder: str) -> str | None:
    """The shared folder's path if workers can map files in it, else None."""
    path = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
    return None if "://" in path else path


class Shard:
    """Sorted keys with columns of counts, memory-mapped: from a file in the shared folder that is gone with the
    mapping, or from none where the shared folder isn't a mounted one."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray], folder: str | None):
        self.n, width = len(keys), 1 + len(columns)
        if not self.n:
            self.keys, self.columns = keys, columns
            return
        size = 8 * self.n * width
        if folder:
            handle, name = tempfile.mkstemp(prefix="ngrams-", dir=folder)
            os.unlink(name)
            os.ftruncate(handle, size)
            mapped = mmap.mmap(handle, size)
            os.close(handle)
        else:
            mapped = mmap.mmap(-1, size)
        table = np.frombuffer(mapped, dtype="<u8").reshape(width, self.n)
        table[0] = keys
        for k, c in enumerate(columns, 1):
            table[k] = c
        self.keys, self.columns = table[0], list(table[1:])

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """Each column's count for each key, 0 where the shard lacks it."""
        if not self.n:
            return [np.zeros(len(keys), np.int64) for _ in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        is_key = self.keys[at] == keys
        return [np.where(is_key, c[at], 0).astype(np.int64) for c in self.columns]


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tn.mix((v & _LOW) * tn.U64(0x9E3779B97F4A7C15) + tn.mix(w & _LOW, 5), 6)


class _Chunk:
    """Tokens of a chunk's documents: every word, then an end for each document."""

    def __init__(self, table: pa.Table):
        text = tn.as_bytes(table["text"])
        n = len(text)
        hashes, rows = [np.zeros(0, tn.U64)], [np.zeros(0, np.int64)]
        for lo, _, buf, offs in tn.chunks(text):
            low = tn.LOWER[buf]
            s, e, r = tn.spans(low, offs, tn.SPACE)
            hashes.append(tn.SubstringHash(low)(s, e))
            rows.append(r + lo)
        words, rows = np.concatenate(hashes), np.concatenate(rows)
        del hashes
        first = tn.first_of_rows(rows, n)
        self.bounds = first + np.arange(n + 1)
        self.token = np.full(len(words) + n, END, dtype=tn.U64)
        self.token[np.arange(len(words)) + rows] = words
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.bounds[:-1]] = BEGIN
        learned = table["learn"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int32) if n else np.zeros(0, np.int32)
        self.learn = np.repeat(learned, np.diff(self.bounds))

    def words(self):
        """Distinct tokens and the beginning: sorted keys, training counts, each token's place in them."""
        order, starts = ex.groups(self.token)
        keys = self.token[order][starts]
        count = np.add.reduceat(self.learn[order], starts) if len(starts) else np.zeros(0, np.int64)
        place = ex.spread(order, starts, np.arange(len(keys)))
        at = int(np.searchsorted(keys, BEGIN))
        return np.insert(keys, at, BEGIN), np.insert(count, at, 0), place + (place >= at), at

    def pairs(self, buckets: int):
        """Distinct pairs in the order they are asked in: hashes, words, training counts, each token's place."""
        h = _pair_hash(self.before, self.token)
        order, starts = ex.groups(h)
        one = order[starts]
        keys, v, w = h[one], self.before[one] & _LOW, self.token[one] & _LOW
        count = np.add.reduceat(self.learn[order], starts) if len(starts) else np.zeros(0, np.int64)
        bounds = ex.bucket_bounds(keys, buckets)
        del h
        # inside a bucket by first word: its bytes then compress
        inner = np.concatenate([np.zeros(0, np.int64), *(a + np.lexsort((keys[a:z], v[a:z])) for a, z in zip(bounds[:-1], bounds[1:], strict=True) if z > a)])
        back = np.empty(len(inner), dtype=np.int64)
        back[inner] = np.arange(len(inner))
        return v[inner], w[inner], count[inner], bounds, back[ex.spread(order, starts, np.arange(len(keys), dtype=np.int32))].astype(np.int32)


def _ask_pairs(chunk: int, table: pa.Table, buckets: int) -> list[ex.Part]:
    v, w, count, bounds, _ = _Chunk(table).pairs(buckets)
    return ex.asks(chunk, PAIRS, bounds, lambda a, z: ex.planes(v[a:z], _ID) + ex.planes(w[a:z], _ID) + ex.small(count[a:z], 4))


def _ask_words(chunk: int, table: pa.Table, buckets: int) -> list[ex.Part]:
    keys, count, _, _ = _Chunk(table).words()
    return ex.asks(chunk, WORDS, ex.bucket_bounds(keys, buckets), lambda a, z: ex.planes(keys[a:z], 8) + ex.small(count[a:z], 4))


class _Pairs:
    """A bucket's pairs."""

    def __init__(self, asking: list[ex.Part]):
        self.parts = [(c, n, ex.from_planes(d, n, _ID), ex.from_planes(d[_ID * n :], n, _ID), ex.from_small(d[2 * _ID * n :], n, 4).astype(np.int64)) for c, n, d in ex.asked(asking, PAIRS)]
        v, w, count = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4))
        h = _pair_hash(v, w)
        order, starts = ex.groups(h)
        count = np.add.reduceat(count[order], starts)
        one = order[starts]
        seen = count > 0
        self.v, self.w, self.count, self.keys = v[one][seen], w[one][seen], count[seen], h[one][seen]


def _answer_pairs(bucket: int, asking: list[ex.Part], folder: str | None) -> list[ex.Part]:
    p = _Pairs(asking)
    shard = Shard(p.keys, [p.count], folder)
    return [(c, PAIRS, bucket, n, ex.small(shard.find(_pair_hash(v, w))[0], _SUM)) for c, n, v, w, _ in p.parts]


def _parts_of_words(bucket: int, asking: list[ex.Part], buckets: int) -> list[ex.Part]:
    """What a bucket's pairs say of their words, to the words' buckets; and its counts of counts."""
    p = _Pairs(asking)
    word = np.concatenate([p.v, p.w])
    n = np.zeros((4, len(word)), dtype=np.int64)
    for k in range(3):
        n[k, : len(p.v)] = p.count == k + 1 if k < 2 else p.count > 2
    n[3, len(p.v) :] = 1
    order, starts = ex.groups(word)
    n = np.add.reduceat(n[:, order], starts, axis=1) if len(starts) else n
    keys = word[order][starts]
    rows = ex.asks(bucket, PARTS, ex.bucket_bounds(keys, buckets), lambda a, z: ex.planes(keys[a:z], _ID) + b"".join(ex.small(x[a:z], _SUM) for x in n))
    return [*rows, (bucket, COUNTS, 0, 1, np.array([(p.count == k).sum() for k in (1, 2, 3, 4)], dtype="<i8").tobytes())]


class _Words:
    """A bucket's words."""

    def __init__(self, asking: list[ex.Part]):
        self.parts = [(c, n, ex.from_planes(d, n, 8), ex.from_small(d[8 * n :], n, 4).astype(np.int64)) for c, n, d in ex.asked(asking, WORDS)]
        keys = np.concatenate([np.zeros(0, tn.U64), *(p[2] for p in self.parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(p[3] for p in self.parts)])
        order, starts = ex.groups(keys)
        count = np.add.reduceat(count[order], starts) if len(starts) else count
        self.keys, self.count = keys[order][starts][count > 0], count[count > 0]
        found = [(ex.from_planes(d, n, _ID), [ex.from_small(d[(_ID + _SUM * k) * n :], n, _SUM).astype(np.int64) for k in range(4)]) for _, n, d in ex.asked(asking, PARTS)]
        keys = np.concatenate([np.zeros(0, tn.U64), *(f[0] for f in found)])
        n = np.concatenate([np.zeros((4, 0), np.int64), *(np.array(f[1]) for f in found)], axis=1)
        order, starts = ex.groups(keys)
        self.n = np.add.reduceat(n[:, order], starts, axis=1) if len(starts) else n
        self.followed = keys[order][starts]
        self.counts = sum((np.frombuffer(d, "<i8") for _, _, d in ex.asked(asking, COUNTS)), np.zeros(4, np.int64))


def _answer_words(bucket: int, asking: list[ex.Part], folder: str | None) -> list[ex.Part]:
    b = _Words(asking)
    shard, smoothing = Shard(b.keys, [b.count], folder), Shard(b.followed, list(b.n), folder)
    return [(c, WORDS, bucket, n, b"".join(ex.small(x, _SUM) for x in (*shard.find(keys), *smoothing.find(keys & _LOW)))) for c, n, keys, _ in b.parts]


_TOTALS = ["tokens", "distinct", "follows", "n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "more"]


def _totals(bucket: int, asking: list[ex.Part]) -> pa.Table:
    b = _Words(asking)
    follows = b.n[3]
    return pa.table({k: [int(x)] for k, x in zip(_TOTALS, [b.count.sum(), len(b.count), follows.sum(), *b.counts, *((follows == k).sum() for k in (1, 2, 3, 4)), (follows > 2).sum()], strict=True)})


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """D(0), D(1), D(2), D(3 or more) from counts of counts; from sparse counts, the nearest that is defined."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(k - (k + 1) * y * b / a, 0.0), k) if a and b else k * y)
    return np.array(d)


def probabilities(pair: np.ndarray, context: np.ndarray, rest: np.ndarray, follows: np.ndarray, t: dict[str, float]) -> np.ndarray:
    """p(w|v) of tokens. pair: c(vw); context: c(v); rest: N1, N2, N3+ of v; follows: words that w follows."""
    m = discounts(t["m1"], t["m2"], t["m3"], t["m4"])
    every = max(t["follows"], 1)
    left = (m[1] * t["m1"] + m[2] * t["m2"] + m[3] * t["more"]) / every if t["follows"] else 1.0
    lower = np.maximum(follows - m[np.minimum(follows, 3)], 0) / every + left / (t["distinct"] + 1)
    d = discounts(t["n1"], t["n2"], t["n3"], t["n4"])
    known = context > 0
    c = np.maximum(context, 1)
    back = (d[1] * rest[0] + d[2] * rest[1] + d[3] * rest[2]) / c
    return np.where(known, np.maximum(pair - d[np.minimum(pair, 3)], 0) / c + back * lower, lower)


def _scores(table: pa.Table, answers: list[ex.Part], buckets: int) -> pa.Table:
    if not table.num_rows:  # totals for a chunk without documents
        return _result(table["doc_id"], table["held_out"], [[]] * 5)
    c = _Chunk(table)
    pair_place = c.pairs(buckets)[-1]
    release()
    pair = np.concatenate([np.zeros(0, np.int64), *(ex.from_small(d, len(d) // _SUM, _SUM).astype(np.int64) for d in ex.each_answer(answers, PAIRS))])[pair_place]
    del pair_place
    keys, _, place, begin = c.words()
    c.token = c.before = c.learn = None
    release()
    stats = np.concatenate([[ex.from_small(d[len(d) // 5 * k :], len(d) // 5 // _SUM, _SUM).astype(np.int64) for k in range(5)] for d in ex.each_answer(answers, WORDS)], axis=1)
    t = dict(zip(_TOTALS, map(int, bytes(next(ex.each_answer(answers, TOTALS))).decode().strip("[]").split(",")), strict=True))
    count, follows = stats[0], stats[4]
    as_context = count.copy()
    as_context[begin] = count[np.searchsorted(keys, END)]  # texts begin as often as they end
    from_ = np.empty(len(place), dtype=np.int64)
    from_[1:] = place[:-1]
    from_[c.bounds[:-1]] = begin
    p = probabilities(pair, as_context[from_], stats[1:4, from_], follows[place], t)
    score = np.add.reduceat(np.log10(p), c.bounds[:-1])
    base = np.add.reduceat(np.log10((count[place] + 1) / (t["tokens"] + t["distinct"] + 1)), c.bounds[:-1])
    known = np.add.reduceat((count[place] > 0).astype(np.int64), c.bounds[:-1])
    n = np.diff(c.bounds)
    return _result(table["doc_id"], table["held_out"], [n, known, np.full(len(n), t["tokens"]), base, score])


def _result(ids, out, columns) -> pa.Table:
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    cols = [pa.array(x, pa.int64() if i < 3 else pa.float64()) for i, x in enumerate(columns)]
    return pa.table([ids, out, *cols], names=["doc_id", "held_out", *names])


def scored(docs: DataFrame, out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; the rows for which
    `out` holds (by default held_out(doc_id)) are scored but not learned from."""
    out = held_out(F.col("doc_id")) if out is None else out
    r = ex.route(docs, CHUNK_BYTES)
    chunks = ex.chunked(docs.select("doc_id", "text", out.alias("held_out"), (~out).alias("learn")), r.chunks)
    pairs = ex.chunk_asks(chunks, r, lambda c, t: _ask_pairs(c, t, r.buckets))
    parts = ex.bucket_asks(pairs, r, lambda b, p: _parts_of_words(b, p, r.buckets))
    words = ex.chunk_asks(chunks, r, lambda c, t: _ask_words(c, t, r.buckets)).unionByName(parts)
    sums = ex.by_bucket(words, r, _totals, ", ".join(f"{k} bigint" for k in _TOTALS))
    totals = sums.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _TOTALS])
    # the one row of totals, to every chunk
    totals = totals.select(F.explode(F.sequence(F.lit(0), F.lit(r.chunks - 1))).alias("c"), F.to_json(F.array(*_TOTALS)).alias("totals")).mapInArrow(_as_parts, ex.PACKED)
    folder = mounted(shared_folder(docs.sparkSession))
    answered = ex.bucket_answers(pairs, r, lambda b, p: _answer_pairs(b, p, folder)).unionByName(ex.bucket_answers(words, r, lambda b, p: _answer_words(b, p, folder)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return ex.with_answers(chunks, answered, r, lambda c, t, a: _scores(t, a, r.buckets), schema, totals)


def _as_parts(batches):
    for b in batches:
        for c, totals in zip(*(x.to_pylist() for x in b.columns), strict=True):
            yield from ex.rows_of([(c, TOTALS, 0, 1, totals.encode())], 1, 1).to_batches()

"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A batch's distinct pieces (the matches of the split pattern) form a small corpus: their
bytes lie in one array of linked tokens, an inverted index maps the rank of each
adjacent token pair to the positions where it stands, and the merges are applied to all
positions in rank order. A merge touches its two neighbours only. Where a merge makes a
pair of a lower rank, that pair goes first, as it does when each piece is encoded alone.

Rows: null texts encode as the empty text; empty texts have no tokens; repeated rows are
answered each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import release

_LOADED: dict[tuple[str, str], Codec] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes pieces by merge replay. Keeps the encoded pieces of two generations of `keep` at most:
    what is used again moves on to the younger, so common pieces are replayed once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 250_000):
        import regex

        self.ranks, self.split, self.keep = ranks, regex.compile(pattern).findall, keep
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)

    def pair_rank(self, left: int, right: int) -> int:
        """Rank of the token that the two make, or -1."""
        key = left * len(self.tokens) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        if not len(raw):
            return [[] for _ in pieces]
        ids = self.single[raw]
        if ids.min() < 0:
            raise ValueError("the vocabulary lacks a single byte")
        n = len(raw)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        firsts = (ends - sizes).tolist()
        last = np.zeros(n, dtype=bool)
        last[ends[sizes > 0] - 1] = True
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1)).tolist()
        token = ids.tolist()
        pair_rank = self.pair_rank
        # the inverted index of the pairs of bytes
        found = np.where(last[:-1], -1, self.byte_pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]])
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        begins = np.flatnonzero(np.diff(found[at], prepend=-1)).tolist()
        ends_of = [*begins[1:], len(at)] if begins else []
        where: dict[int, list[int]] = {int(found[at[x]]): at[x:y].tolist() for x, y in zip(begins, ends_of, strict=True)}
        order = list(where)
        heapq.heapify(order)
        known, size = self.pairs.get, len(self.tokens)
        while order:
            rank = heapq.heappop(order)
            places = where.pop(rank)
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                t = token[i]
                if j < 0 or t < 0:
                    continue  # merged away meanwhile
                r = known(t * size + token[j])
                if (pair_rank(t, token[j]) if r is None else r) != rank:
                    continue
                token[i], token[j] = rank, -1
                after[i] = nxt = after[j]
                lowest = rank
                if nxt >= 0:
                    before[nxt] = i
                    t = token[nxt]
                    r = known(rank * size + t)
                    if r is None:
                        r = pair_rank(rank, t)
                    if r >= 0:
                        lowest = r if r < lowest else lowest
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(order, r)
                prv = before[i]
                if prv >= 0:
                    t = token[prv]
                    r = known(t * size + rank)
                    if r is None:
                        r = pair_rank(t, rank)
                    if r >= 0:
                        lowest = r if r < lowest else lowest
                        if r in where:
                            where[r].append(prv)
                        else:
                            where[r] = [prv]
                            heapq.heappush(order, r)
                if lowest < rank and k + 1 < len(places):
                    if rank in where:
                        where[rank].extend(places[k + 1 :])
                    else:
                        where[rank] = places[k + 1 :]
                        heapq.heappush(order, rank)
                    break
        out = []
        for piece, i in zip(pieces, firsts, strict=True):
            ids = []
            while piece and i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Makes the pieces known, those new to both generations in one replay."""
        if len(self.known) + len(pieces) > self.keep:
            self.known, self.older = {}, self.known
        rest = []
        for p in pieces:
            if (ids := self.known.get(p) or self.older.get(p)) is not None:
                self.known[p] = ids
            elif (whole := self.ranks.get(p.encode())) is not None:
                self.known[p] = whole.to_bytes(4, "little")
            else:
                rest.append(p)
        for p, ids in zip(rest, self.replay([p.encode() for p in rest]), strict=True):
            self.known[p] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1 << 20):
                size += len(texts[hi])
                hi += 1
            split = [self.split(t) for t in texts[lo:hi]]
            wanted = set().union(*split)
            missing = wanted.difference(self.known)
            if missing:
                self.learn(wanted if len(self.known) + len(missing) > self.keep else missing)
            known = self.known
            for pieces in split:
                yield b"".join([known[p] for p in pieces])
            lo = hi

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids from encode() stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Codec(load_ranks(path), pattern)
    return _LOADED[key]


def encode_frame(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the token ids of text_col as binary (little-endian u32) in out_col (replaced if there)."""
    return _encoded(docs, path, pattern, text_col, {out_col: pa.binary()}, lambda c, t, ids: (ids,))


def decode_frame(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that ids_col stands for in out_col; null ids decode as empty."""
    keep = [c for c in df.columns if c != out_col]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array([c.decode(x or b"") for x in ids], pa.binary())], names=[*keep, out_col])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep), f"`{out_col}` binary"]))


def _encoded(docs, path, pattern, text_col, new: dict, row) -> DataFrame:
    keep = [f for f in docs.schema if f.name not in new]
    at = [f.name for f in keep].index(text_col)
    kinds = {pa.binary(): "binary", pa.int64(): "bigint", pa.string(): "string"}

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            made = [row(c, t, ids) for t, ids in zip(texts, c.encode(texts), strict=True)]
            cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(new.values())]
            del texts, made
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), *cols], names=[*(f.name for f in keep), *new])
            release()

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"`{k}` {kinds[v]}" for k, v in new.items())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; the decoded bytes come from the ids."""

    def row(c, text, ids):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _encoded(docs.select("doc_id", "text"), path, pattern, "text", new, row).drop("text")

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of 13 words (items of fewer words are one pattern
each). Per pattern length m: a shift table over blocks of B words says how far the search
may move on, a hash of the last block selects the patterns to test, and a comparison of
the words themselves confirms an occurrence. Patterns are searched in blocks of items, and
after every few blocks the documents found so far are written to the shared folder, so that
neither what is shipped to the workers nor the plan grows with the benchmark; the number of
passes over the documents does, one for each block.

Rows: null and empty texts have no words; items without words are no pattern; equal patterns
of several items count for each of them; items of a null id hit words and count together as
one item, which has no place in the list of ids' text; repeated rows are answered each; extra
columns pass through as they are, but for those that are returned; an empty benchmark hits
nothing; an empty table gives an empty result. A text is held by one task, as a list of words.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: fixed values: what a word is, the window, the block of the shift table
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW, BLOCK = 13, 3
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_UPPER)) if text else []


class WuManber:
    """All patterns of one length m. find() gives (start, pattern's items) of each occurrence."""

    def __init__(self, patterns: dict[tuple[str, ...], dict[str | None, None]]):
        self.m = len(next(iter(patterns)))
        self.b = min(BLOCK, self.m)
        self.far = self.m - self.b + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.tests: dict[tuple[str, ...], list[tuple[tuple[str, ...], dict[str | None, None]]]] = {}
        for p, items in patterns.items():
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.tests.setdefault(p[self.m - self.b :], []).append((p, items))

    def find(self, words: list[str]):
        m, b, far, shift, at, n = self.m, self.b, self.far, self.shift, self.m, len(words)
        words = tuple(words)
        while at <= n:
            block = words[at - b : at]
            move = shift.get(block, far)
            if move:
                at += move
                continue
            window = words[at - m : at]
            for pattern, items in self.tests[block]:
                if pattern == window:
                    yield at - m, items
            at += 1


def patterns_of(items: list[tuple[str | None, str | None]]) -> dict[int, dict[tuple[str, ...], dict[str | None, None]]]:
    """By length: pattern to the ids of the items that hold it."""
    found: dict[int, dict[tuple[str, ...], dict[str | None, None]]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            p = tuple(w[i : i + WINDOW])
            found.setdefault(len(p), {}).setdefault(p, {})[item] = None
    return found


def _item_blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of (item_id as text, text), each of about block_bytes, streamed to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        block.append((r.i, r.text))
        size += len(r.text or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 1 << 20, passes: int = 4) -> DataFrame:
    """docs' columns plus n_words, hits (array of [start, end) word spans, disjoint) and items (sorted ids).

    One pass over docs for each block of benchmark text (1 MB by default); a further pass
    extends the former's spans and items. After `passes` of them the result is written down.
    """
    names = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(*[F.col(f"`{c}`") for c in names])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    done = 0
    for block in _item_blocks(benchmark, block_bytes):
        if done and done % passes == 0:
            out = written(out, "decontaminated")
        out = _searched(out, names, kept, patterns_of(block), not done)
        done += 1
    return out if done else _searched(out, names, kept, {}, True)


def _searched(df: DataFrame, names: list[str], kept: str, patterns: dict, first: bool) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(patterns)
    at = names.index("text")

    def run(batches):
        searches = [WuManber(p) for p in shipped.value.values()]
        for b in batches:
            n_words, hits, items = [], [], []
            before = [None] * b.num_rows if first else list(zip(b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2).to_pylist(), strict=True))
            for text, had in zip(b.column(at).to_pylist(), before, strict=True):
                w = words_of(text)
                spans, ids = ([tuple(s.values()) for s in had[0]], set(had[1])) if had else ([], set())
                for s in searches:
                    for start, found in s.find(w):
                        spans.append((start, start + s.m))
                        ids.update(found)
                n_words.append(len(w))
                hits.append(_union(spans))
                items.append(sorted(ids, key=lambda i: (i is None, i or "")))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(n_words, pa.int64()), pa.array([[{"s": s, "e": e} for s, e in x] for x in hits], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names=[*names, "n_words", "hits", "items"],
            )

    return df.mapInArrow(run, f"{kept}, n_words bigint, hits array<struct<s:bigint,e:bigint>>, items array<string>")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """matches() plus n_hit, n_items and contaminated: at least a twentieth of the words is hit."""
    m = matches(docs, benchmark)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    m = m.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")})
    return m.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    j = judged(docs.select("doc_id", "text"), benchmark)
    return j.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

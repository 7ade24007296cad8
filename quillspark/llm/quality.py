"""Quality rules by distribution divergence.

Each document's character-class and common-word histograms are held against references
of its likeliest language by Jensen-Shannon distance (square root of the divergence in
bits, 0 to 1). The references are the summed histograms of all documents of a language
that pass the base rules and the method's own verdict by first references, summed over
all that pass the base rules: so junk doesn't move what it is held against. The largest
character distance is wider for shorter texts, whose histograms stray more by chance.
Minimum lengths guard both tests: a short text has too few characters or words for its
histogram to mean anything, so it is not failed by it.

Rows: null and empty texts have no words and fail the base rules; empty tables give empty
results and, as references, tables of zeros, against which nothing fails; rows of an
unlisted or null language form no reference but are judged like others; equal distances
to several languages go to the first in the order of their names; repeated rows are
answered each; extra columns are ignored. A text is held by one task.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

#: fixed values: the languages that have a reference and their commonest function words
COMMON = {
    "de": "der die das und in zu den von mit sich ist nicht ein eine auf für als auch es an dem im sie",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or",
    "es": "el la de que y en un ser se no los por con para una su al lo como más pero sus le del las es",
    "fr": "le la de et les des en un une que qui dans pour pas sur est par au avec il ne se ce plus du",
}
#: fixed values: characters counted as symbols, and the base rules' limits
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: fixed values of the method: guards and largest distances
MIN_CHARS, MIN_COMMON_WORDS = 200, 250
MAX_WORD_DISTANCE = 0.335
#: largest character distance: the first number, and the second over the square root of the characters
CHAR_DISTANCE, CHAR_STRAY = 0.13, 2.0

LANGS = sorted(COMMON)
WORDS = sorted({w for t in COMMON.values() for w in t.split()})
CLASSES = 9
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_NEWLINE = np.zeros(256, dtype=bool)
_IS_NEWLINE[0x0A] = True


def _class_table() -> np.ndarray:
    """By byte: lower, upper, digit, space, mark, symbol, Latin letter with an accent, other script, control; -1 inside a character."""
    t = np.full(256, 8, dtype=np.int64)
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A] = 0, 1, 2
    t[tn.SPACE] = 3
    for b in range(0x21, 0x7F):
        if not chr(b).isalnum():
            t[b] = 4 if chr(b) in ".,;:!?'\"()-" else 5
    t[0x80:0xC0], t[0xC0:], t[0xC3:0xCA] = -1, 7, 6
    return t


_CLASS = _class_table()


@cache
def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in WORDS]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    h = tn.SubstringHash(np.frombuffer(b"".join(raw), np.uint8))(offs[:-1], offs[1:])
    order = np.argsort(h)
    return h[order], order


def histograms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: counts by character class, and of each common word with all other words last."""
    n = len(offs) - 1
    kind = _CLASS[buf]
    row = np.repeat(np.arange(n), np.diff(offs))
    real = kind >= 0
    chars = np.bincount(row[real] * CLASSES + kind[real], minlength=n * CLASSES).reshape(n, CLASSES)
    curly = row[:-1][(buf[:-1] == 0xE2) & (buf[1:] == 0x80)]  # U+2000 to U+203F: dashes, quotes, ellipses are marks
    np.add.at(chars, (curly, 7), -1)
    np.add.at(chars, (curly, 4), 1)
    low = tn.LOWER[buf]
    s, e, r = tn.spans(low, offs, _NOT_LETTER)
    keys, order = _common_hashes()
    if not len(s):
        return chars, np.zeros((n, len(WORDS) + 1), dtype=np.int64)
    h = tn.SubstringHash(low)(s, e)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    which = np.where(keys[at] == h, order[at], len(WORDS))
    return chars, np.bincount(r * (len(WORDS) + 1) + which, minlength=n * (len(WORDS) + 1)).reshape(n, -1)


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per row."""
    n = len(offs) - 1
    s, e, r = tn.spans(buf, offs, tn.SPACE)
    first = tn.first_of_rows(r, n)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    out = {"n_words": np.diff(first), "word_chars": tn.sums(lead[e] - lead[s], first), "n_symbols": tn.sums(_IS_SYMBOL[buf], offs)}
    if not len(s):
        return out | {"n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    hashed = tn.SubstringHash(buf)
    # lines: non-empty runs between newlines that hold a word
    ls, le, lr = tn.spans(buf, offs, _IS_NEWLINE)
    worded = np.concatenate([[0], np.cumsum(~tn.SPACE[buf])])
    has = worded[le] > worded[ls]
    ls, le, lr = ls[has], le[has], lr[has]
    key = tn.mix(hashed(ls, le) ^ tn.mix(lr.astype(tn.U64), 11))
    _, firsts = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[firsts] = False
    out["n_dup_lines"] = np.bincount(lr[again], minlength=n)
    # windows of five words that stand twice or more in one text
    k = REPEAT_WINDOW
    h = tn.windows(hashed(s, e), k)
    repeated = np.zeros(len(s), dtype=bool)
    if len(h):
        one = np.flatnonzero(r[: len(h)] == r[k - 1 :])
        key = tn.mix(h[one] ^ tn.mix(r[one].astype(tn.U64), 13))
        order = np.argsort(key)
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        repeated = tn.cover(one[order[same[1:] | same[:-1]]], k, len(s))
    out["n_repeat_words"] = tn.sums(repeated, first)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of counts p to the counts q; 0 where either is all zero."""
    sp, sq = p.sum(axis=1, keepdims=True), q.sum()
    if not sq:
        return np.zeros(len(p))
    a, b = p / np.maximum(sp, 1), q / sq
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1) + np.where(b > 0, b * np.log2(b / m), 0).sum(axis=1)
    return np.where(sp[:, 0] > 0, np.sqrt(np.clip(d / 2, 0, 1)), 0)


Refs = dict[str, tuple[np.ndarray, np.ndarray]]


def verdict(chars: np.ndarray, words: np.ndarray, refs: Refs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character distance, word distance, fails) of rows of histograms, by the language whose words are nearest."""
    held = [x for x in LANGS if refs[x][0].any()] or LANGS  # languages without documents are no reference
    by_word = np.array([distance(words, refs[x][1]) for x in held])
    like, rows = by_word.argmin(axis=0), np.arange(len(chars))
    cd, wd = np.array([distance(chars, refs[x][0]) for x in held])[like, rows], by_word[like, rows]
    n_chars, n_words = chars.sum(axis=1), words.sum(axis=1)
    strange = (n_chars >= MIN_CHARS) & (cd > CHAR_DISTANCE + CHAR_STRAY / np.sqrt(np.maximum(n_chars, 1)))
    return cd, wd, strange | ((n_words >= MIN_COMMON_WORDS) & (wd > MAX_WORD_DISTANCE))


def references(docs: DataFrame) -> Refs:
    """Summed histograms by language over all documents that pass the base rules and first references."""
    return summed(docs, summed(docs))


def summed(docs: DataFrame, first: Refs | None = None) -> Refs:
    """Histograms summed over all documents that pass the base rules, and `first` where given: len(LANGS) rows,
    whatever the input."""
    width = CLASSES + len(WORDS) + 1

    def run(batches):
        total = np.zeros((len(LANGS), width), dtype=np.int64)
        for b in batches:
            lang = np.array([LANGS.index(x) if x in COMMON else -1 for x in b.column(1).to_pylist()], dtype=np.int64)
            for lo, hi, buf, offs in tn.chunks(b.column(0)):
                good = (lang[lo:hi] >= 0) & ~base_failed(base_counts(buf, offs))
                chars, words = histograms(buf, offs)
                if first is not None:
                    good &= ~verdict(chars, words, first)[2]
                np.add.at(total, lang[lo:hi][good], np.hstack([chars, words])[good])
        yield pa.RecordBatch.from_arrays([pa.array(LANGS), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["lang", "counts"])

    parts = docs.select("text", F.col("lang")).mapInArrow(run, "lang string, counts array<bigint>")
    rows = parts.select("lang", F.posexplode("counts").alias("k", "c")).groupBy("lang", "k").agg(F.sum("c").alias("c")).collect()
    found = {x: np.zeros(width, dtype=np.int64) for x in LANGS}
    for r in rows:
        found[r.lang][r.k] = r.c
    return {x: (c[:CLASSES], c[CLASSES:]) for x, c in found.items()}


def rules(docs: DataFrame, refs: Refs | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance, kept of every row."""
    refs = references(docs) if refs is None else refs
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in [*counts, "base_failed", "char_distance", "word_distance", "kept"]}
            for _, _, buf, offs in tn.chunks(b.column(1)):
                c = base_counts(buf, offs)
                failed = base_failed(c)
                chars, words = histograms(buf, offs)
                cd, wd, bad = verdict(chars, words, refs)
                for k, v in (*c.items(), ("base_failed", failed), ("char_distance", cd), ("word_distance", wd), ("kept", ~failed & ~bad)):
                    out[k].append(v)
            if not out["kept"]:
                continue
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(v)) for v in out.values())], names=["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} bigint' for k in counts)}, base_failed boolean, char_distance double, word_distance double, kept boolean")

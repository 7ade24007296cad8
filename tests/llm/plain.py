"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import math
import re

import numpy as np
import xxhash

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def suffix_dedup(rows):
    """rows: (doc_id, text); result by position."""
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in data:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return out


def substring_dedup(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    big = 2**63 - 1
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (big if i is None else i):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode())))
    return out


def fingerprint(text, size, few=0):
    w = WORD.findall((text or "").translate(UP))
    if not w:
        return 0
    if max(1, len(w) - size + 1) < few:
        return xxhash.xxh64_intdigest(" ".join(w).encode(), seed=42)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), seed=42) for k in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(rows, size, radius, few=0):
    """(doc_id, fingerprint, component) by position."""
    fp = [fingerprint(t, size, few) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{fp[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]


def contamination(rows, items):
    patterns = {}
    for item, text in items:
        w = BENCH.findall((text or "").translate(UP))
        for k in range(max(1, len(w) - 12) if w else 0):
            patterns.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    out = []
    for i, text in rows:
        w = BENCH.findall((text or "").translate(UP))
        hit, ids = set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if k + n <= len(w) and (found := patterns.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def base_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    again = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))


def char_class(c):
    o = ord(c)
    if "a" <= c <= "z" or "A" <= c <= "Z" or "0" <= c <= "9":
        return 0 if c >= "a" else 1 if c >= "A" else 2
    if c == " " or 9 <= o <= 13:
        return 3
    if o < 128:
        return 4 if c in ".,;:!?'\"()-" else 5 if 0x20 < o < 0x7F else 8
    return 4 if 0x2000 <= o <= 0x203F else 6 if 0xC0 <= o <= 0x27F else 7


def jensen_shannon(p, q):
    """Distance of two lists of counts."""
    if not sum(p) or not sum(q):
        return 0.0
    d = 0.0
    for a, b in zip(p, q, strict=True):
        a, b = a / sum(p), b / sum(q)
        m = (a + b) / 2
        d += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(min(max(d / 2, 0), 1))


def quality_verdicts(rows, common):
    """(char_distance, word_distance, fails) of rows (text, lang, whether the base rules fail it)."""
    langs, vocabulary = sorted(common), sorted({w for t in common.values() for w in t.split()})

    def histograms(text):
        chars, words = [0] * 9, [0] * (len(vocabulary) + 1)
        for c in text or "":
            chars[char_class(c)] += 1
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-z\x80-\U0010ffff]+", lowered):
            words[vocabulary.index(w) if w in vocabulary else -1] += 1
        return chars, words

    h = [histograms(t) for t, _, _ in rows]

    def references(use):
        out = {x: ([0] * 9, [0] * (len(vocabulary) + 1)) for x in langs}
        for (_, lang, _), both, ok in zip(rows, h, use, strict=True):
            if ok and lang in out:
                for total, counts in zip(out[lang], both, strict=True):
                    total[:] = [a + b for a, b in zip(total, counts, strict=True)]
        return out

    def judge(refs):
        held = [x for x in langs if any(refs[x][0])] or langs
        out = []
        for chars, words in h:
            like = min(held, key=lambda x: jensen_shannon(words, refs[x][1]))
            cd, wd, n = jensen_shannon(chars, refs[like][0]), jensen_shannon(words, refs[like][1]), sum(chars)
            out.append((cd, wd, (n >= 200 and cd > 0.13 + 2 / math.sqrt(n)) or (sum(words) >= 250 and wd > 0.335)))
        return out

    passing = [not failed for _, _, failed in rows]
    first = judge(references(passing))
    return judge(references([ok and not bad for ok, (_, _, bad) in zip(passing, first, strict=True)]))

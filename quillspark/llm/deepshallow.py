"""Deep-shallow sorting of many byte strings, with the longest common prefixes of neighbours.

Shallow: multikey quicksort (three-way partition of every open segment at once, seven
bytes at a time) to a depth of 35 bytes. Deep: the strings that still share a prefix go
through a blind trie for each segment: a string descends by its branching bytes alone, is
compared once with the leaf it reaches, and is hung in at the depth where the two differ.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_WORD, _ROUNDS = 7, 5
SHALLOW = _WORD * _ROUNDS


def _words(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, depth: int) -> np.ndarray:
    """Seven bytes at `depth` of each string, then how many of them are the string's own: compares like the rest."""
    own = np.clip(lens - depth, 0, _WORD)
    out = own.astype(U64)
    at = starts + depth
    for k in range(_WORD):
        byte = buf[np.minimum(at + k, len(buf) - 1)].astype(U64)
        out |= np.where(own > k, byte, U64(0)) << U64(8 * (_WORD - k))
    return out


def _quick(segment: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Multikey quicksort of one word: the order that sorts `words` inside each run of equal `segment`."""
    order = np.arange(len(words))
    part = segment.astype(np.int64)
    open_ = np.arange(len(words))  # places that lie in a part with more than one word value
    while len(open_):
        p, w = part[open_], words[order[open_]]
        begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.concatenate([begins, [len(p)]]))
        a, b, c = w[begins], w[begins + size // 2], w[begins + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)  # median of three
        side = np.where(w < pivot, 0, np.where(w == pivot, 1, 2))
        moved = np.argsort(np.repeat(np.arange(len(begins)), size) * 3 + side, kind="stable")
        order[open_] = order[open_][moved]
        side = side[moved]
        # parts are numbered by where they begin, so that they stay apart and in order
        fresh = np.concatenate([[True], (side[1:] != side[:-1]) | (p[1:] != p[:-1])])
        part[open_] = np.maximum.accumulate(np.where(fresh, open_, -1))
        width = np.diff(np.concatenate([np.flatnonzero(fresh), [len(p)]]))
        open_ = open_[(side != 1) & (np.repeat(width, width) > 1)]
    return order


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Inner nodes are [depth, children by byte (-1: the string ends)]; leaves are (string, ids)."""

    def __init__(self, known: int):
        self.known, self.root = known, None

    def insert(self, s: bytes, ident: int) -> None:
        if self.root is None:
            self.root = (s, [ident])
            return
        path, node = [], self.root
        while type(node) is list:
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        common = lcp(s, node[0], self.known)
        if common == len(s) == len(node[0]):
            node[1].append(ident)
            return
        mine = s[common] if common < len(s) else -1
        theirs = node[0][common] if common < len(node[0]) else -1
        below, above = node, None
        for n in path:
            if n[0] >= common:
                below = n
                break
            above = n
        if type(below) is list and below[0] == common:
            below[1][mine] = (s, [ident])
            return
        new = [common, {theirs: below, mine: (s, [ident])}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = new

    def walk(self):
        """(id, common prefix with the one before) in sorted order; the first has 0."""
        stack, shared = [(self.root, 0)], 0
        while stack:
            node, depth = stack.pop()
            if type(node) is list:
                for k, c in enumerate(sorted(node[1], reverse=True)):
                    stack.append((node[1][c], depth if k == len(node[1]) - 1 else node[0]))
            else:
                shared = depth
                for i in node[1]:
                    yield i, shared
                    shared = len(node[0])


def sort(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings sorted inside each run of equal `group` (which must be sorted);
    common[i] is the prefix that order[i] shares with order[i - 1], -1 where a group begins."""
    n = len(starts)
    common = np.zeros(n, dtype=np.int64)
    if not n:
        return np.zeros(0, np.int64), common
    order = np.arange(n)
    edge = np.concatenate([[True], group[1:] != group[:-1]])
    common[edge] = -1
    segment = np.cumsum(edge)
    for r in range(_ROUNDS):
        alone = edge & np.concatenate([edge[1:], [True]])
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        w = _words(buf, starts[order[live]], lens[order[live]], r * _WORD)
        moved = _quick(segment[live], w)
        order[live], w = order[live][moved], w[moved]
        split = np.zeros(n, dtype=bool)
        differ = w[1:] != w[:-1]
        split[live[1:][differ]] = True
        split &= ~edge
        at = np.flatnonzero(split)
        if len(at):
            place = np.searchsorted(live, at)
            x = w[place] ^ w[place - 1]
            same = np.zeros(len(at), dtype=np.int64)
            going = np.ones(len(at), dtype=bool)
            for k in range(_WORD):
                going &= (x >> U64(8 * (_WORD - k))) & U64(0xFF) == 0
                same += going
            own = np.minimum(lens[order[at]], lens[order[at - 1]]) - r * _WORD
            common[at] = r * _WORD + np.minimum(same, np.maximum(own, 0))
            edge |= split
            segment = np.cumsum(edge)
    begins = np.flatnonzero(edge)
    ends = np.concatenate([begins[1:], [n]])
    many = np.flatnonzero(ends - begins > 1)
    if len(many):
        data = buf.tobytes()
        s, ln = starts.tolist(), lens.tolist()
        for b, e in zip(begins[many].tolist(), ends[many].tolist(), strict=True):
            members = order[b:e].tolist()
            if ln[members[0]] <= SHALLOW and max(ln[m] for m in members) <= SHALLOW:  # all ended: equal
                common[b + 1 : e] = [ln[m] for m in members[1:]]
                continue
            trie = BlindTrie(min(SHALLOW, min(ln[m] for m in members)))
            for m in members:
                trie.insert(data[s[m] : s[m] + ln[m]], m)
            ids, shared = zip(*trie.walk(), strict=True)
            order[b:e] = ids
            common[b + 1 : e] = shared[1:]
    return order, common

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import exchange as ex
from quillspark.llm import textnum as tn

longs = st.lists(st.integers(0, 2**64 - 1), max_size=50).map(lambda x: np.array(sorted(x), dtype=np.uint64))


@given(longs)
def test_planes_come_back(keys):
    n = len(keys)
    assert (ex.from_planes(ex.planes(keys, 8), n, 8) == keys).all()
    top = keys & np.uint64(0xFFFFFFFFFF000000)
    assert (ex.from_planes(ex.planes(keys, 5), n, 5) == top).all()
    low = keys & np.uint64(0xFFFFFFFF)
    assert (ex.from_small(ex.small(keys, 4), n, 4) == low).all()


@given(longs, st.integers(1, 300))
def test_buckets_are_even_ranges(keys, count):
    bounds = ex.bucket_bounds(keys, count)
    assert len(bounds) == count + 1 and bounds[0] == 0 and bounds[-1] == len(keys) and (np.diff(bounds) >= 0).all()
    for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        assert all(int(k) * count >> 64 == b for k in keys[lo:hi])


@given(st.lists(st.integers(0, 5), max_size=40))
def test_groups_and_spread(values):
    keys = np.array(values, dtype=np.uint64)
    order, starts = ex.groups(keys)
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    assert ex.spread(order, starts, size).tolist() == [values.count(v) for v in values]


texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x1fA ", max_size=30)), max_size=12)


@settings(max_examples=200)
@given(texts, st.integers(1, 40))
def test_words_of_chunks(rows, target):
    column = pa.array(rows, pa.string())
    seen = []
    for lo, hi, buf, offs in tn.chunks(column, target):
        assert lo == len(seen)
        s, e, r = tn.spans(buf, offs, tn.SPACE)
        words = [[] for _ in range(hi - lo)]
        for a, b, k in zip(s, e, r, strict=True):
            words[k].append(buf[a:b].tobytes())
        seen += words
    assert seen == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in rows]


@settings(max_examples=200)
@given(st.binary(max_size=60), st.integers(0, 1))
def test_equal_bytes_hash_alike_and_others_apart(data, kind):
    buf = np.frombuffer(data, np.uint8)
    h = tn.SubstringHash(buf, kind)
    at = [(a, z) for a in range(len(data) + 1) for z in range(a, len(data) + 1)]
    got = h(np.array([a for a, _ in at]), np.array([z for _, z in at]))
    by = {}
    for (a, z), x in zip(at, got.tolist(), strict=True):
        assert by.setdefault(data[a:z], x) == x
    assert len(set(by.values())) == len(by)


@given(st.sets(st.integers(0, 49)), st.integers(1, 20))
def test_cover(starts, size):
    want = [any(s <= k < s + size for s in starts) for k in range(50)]
    assert tn.cover(np.array(sorted(starts), dtype=np.int64), size, 50).tolist() == want


def test_windows_know_order():
    h = np.array([1, 2, 3, 2, 1, 2, 3], dtype=np.uint64)
    w = tn.windows(h, 3)
    assert w[0] == w[4] and len(set(w.tolist())) == 4 and len(tn.windows(h, 8)) == 0

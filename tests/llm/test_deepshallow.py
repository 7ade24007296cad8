import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import deepshallow as d

short = st.lists(st.tuples(st.integers(0, 3), st.lists(st.sampled_from([b"a", b"b", b"\0", b"a" * 20, b"ab" * 30]), max_size=6).map(b"".join)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(short)
def test_order_and_common_prefixes(rows):
    rows.sort(key=lambda r: r[0])
    lens = np.array([len(s) for _, s in rows], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1].astype(np.int64)
    buf = np.frombuffer(b"".join(s for _, s in rows) + b"x", np.uint8)
    group = np.array([g for g, _ in rows], dtype=np.int64)
    order, common = d.sort(buf, starts, lens, group)
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for i, x in enumerate(common):
        if i and got[i][0] == got[i - 1][0]:
            assert x == len(os.path.commonprefix([got[i][1], got[i - 1][1]]))
        else:
            assert x == -1

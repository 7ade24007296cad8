"""The way round hot anchors is taken: their strings are sent by hashes of their own, not gathered as stretches."""

import pyarrow as pa

from quillspark.llm import suffixes


def kinds(hot):
    passage = " ".join(f"word{k}" for k in range(80))
    table = pa.table({"text": [f"{k} {passage} {k * 7}" for k in range(6)]})
    asked = suffixes._ask_anchors(0, table, 1)
    answers = suffixes._answer_anchors(0, asked, hot)
    return {row[1] for row in suffixes._ask_stretches(0, table, answers, 1)}


def test_hot_anchors_are_not_gathered():
    assert kinds(suffixes.HOT) == {1}
    assert kinds(0) == {2}

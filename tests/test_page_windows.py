"""Segments found on pages by their first 12, 8, 6 or 4 words, across lines and within their chapter."""

from quillspark.operators import structure as st


def test_page_windows(spark):
    w = [f"w{k}" for k in range(12)]
    items = spark.createDataFrame([("a", " ".join(w)), ("b", "two words"), ("c", "")], "item_id string, text string")
    pages = [(1, "x " + " ".join(w)), (2, " ".join(w[:3]) + "\n" + " ".join(w[3:9])), (3, " ".join([*w[:6], "z"])), (4, " ".join([*w[:4], "z"])), (5, " ".join(w[:3])), (6, "Two\nwords"), (7, None)]
    pages = spark.createDataFrame(pages, "page int, text string")
    read = lambda df: {(r.item_id, r.page): r.window for r in df.collect()}
    assert read(st.page_windows(items, pages)) == {("a", 1): 12, ("a", 2): 8, ("a", 3): 6, ("a", 4): 4, ("b", 6): 2}
    ranges = spark.createDataFrame([("a", 2, 3), ("b", 1, 5)], "item_id string, start_page int, end_page int")
    assert read(st.page_windows(items, pages, ranges)) == {("a", 2): 8, ("a", 3): 6}

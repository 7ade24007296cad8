"""Scalar rules on golden rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedding, preprocess
from quillspark.functions import text as t
from quillspark.operators import lines as ln


def values(spark, rows, col):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_kinds(spark):
    rows = {"": "paragraph", "* * *": "scene_break", "— yes": "dialogue", "“Yes”": "dialogue", "> quoted": "quotation", "Dear John": "letter", "it ends. Yours, B": "letter", "An old saying": "epigraph", "Plain text.": "paragraph", "------": "scene_break", None: "paragraph"}
    assert values(spark, list(rows), t.paragraph_kind("x")) == list(rows.values())


def test_sentences_and_tokens(spark):
    assert values(spark, ["One. Two!  Three… four", "", " a "], t.sentences("x")) == [["One.", "Two!", "Three…", "four"], [], ["a"]]
    # word of five: 2, blank: 1, marks of four: 2
    assert values(spark, ["abcde ....", "", None], t.estimated_tokens("x")) == [5, 0, 0]


def test_head_tail(spark):
    rows = {"Prima frase. Seconda frase. Ultima frase": "Prima frase. Ultima frase", "Una. Due. Tre.": "Una. Tre.", "Sola": "Sola", "": "", None: ""}
    assert values(spark, list(rows), t.head_tail("x")) == list(rows.values())


def test_compare_and_copies(spark):
    assert values(spark, ["“A” — b…", " X  y\n"], t.for_compare("x")) == ['"a" -- b...', "x y"]
    assert values(spark, ["ALIEN CLAY", "978 3 16 148410 0", "To Everyone Fighting The Mandate", None], t.copy_allowed("x")) == [True, True, False, True]


def test_headings(spark):
    rows = ["CHAPTER III", "Part: the first", "Book of days", "A quiet line"]
    assert values(spark, rows, t.lexical_score("x")) == [0.95, 0.72, 0.95, 0.0]
    assert values(spark, rows, t.normal_title("x")) == ["Chapter III", "Part: the first", "Book of days", "A quiet line"]
    assert values(spark, rows, t.node_kind("x")) == ["chapter", "part", "part", "chapter"]
    assert values(spark, ["CHAPTER III"], t.typographic_score("x", F.lit(1.6), F.lit(0.0)))[0] == pytest.approx(0.9)


def test_names_and_brackets(spark):
    assert values(spark, ["The  King's", "an Élan!", "a"], t.name_key("x")) == ["king", "élan", "a"]
    assert values(spark, ["(a [b] ", r"\(a)", "«»"], t.bracket_balance("x")) == [1, -1, 0]


def test_markers(spark):
    rows = ["il gatto non c'era", "la città", "the cat", "i gatti e i cani"]
    assert values(spark, rows, t.has_markers("x", "it")) == [True, True, False, True]


def test_segment_ids_are_uuid5(spark):
    df = spark.createDataFrame([("p", "c", 7)], "p string, c string, n int")
    space = uuid.uuid5(uuid.NAMESPACE_URL, "quillspark:segment:v1")
    assert df.select(ln.segment_id("p", "c", "n")).first()[0] == str(uuid.uuid5(space, "p:c:7"))


def test_embedding():
    v = embedding.embed_text("Good morning")
    assert len(v) == 768 and not v[384:].any() and abs((v * v).sum() - 1) < 1e-9 and not embedding.embed_text("").any()


@pytest.mark.parametrize("text", ["", "“q” 'p' \"r\"", "see https://x.y/z, mail a.b@c.de or 3,141 and 3,141", "⟦URL1⟧ stays", "‘a’ ’ 12.5% 12.5", 'plain " and “fancy”'])
def test_prepared_texts_come_back(text):
    normalised, changes = preprocess.with_skips(text)
    assert preprocess.restore_text(normalised, changes) == text


def test_prepare_over_a_table(spark):
    texts = ["“Call 12” now", None, "á x@y.zz"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = df.withColumn("p", preprocess.prepare("x")).select("i", "p.normalised", preprocess.restore("p").alias("back")).orderBy("i").collect()
    assert [r.back for r in got] == ["“Call 12” now", "", "á x@y.zz"] and got[0].normalised == '"Call ⟦NUMBER1⟧" now'


def test_sequential_rules():
    assert preprocess.dehyphenate_text("some- thing s- omething rain- fall") == "some- thing s-omething rain- fall"
    assert preprocess.error_rate(list("kitten"), list("sitting")) == pytest.approx((6 + 7 - 2 * 4) / 6)
    assert preprocess.error_rate([], []) == 0 and preprocess.error_rate([], ["x"]) == 1
    assert preprocess.parse_answer('```json\n{"a": "x\ny"}\n```') == '{"a": "x\\ny"}' and preprocess.parse_answer("no") is None
    assert [d["op"] for d in preprocess.diff_ops("a b c", "a x c")] == ["equal", "delete", "insert", "equal"]


def test_json_as_the_sql_has_it(spark):
    """Texts that begin like a number, and odd ones, against DuckDB's json_valid."""
    import random

    import duckdb

    r = random.Random(5)
    parts = ["[", "]", "{", "}", ",", ":", '"a"', '"', "1", "-", "0", ".5", "e5", "nan", "-INF", "Infinity", "true", "null", " ", "\n", "\t", "\x0b", " ", "\\u12", '"\\u00e9"', '"\\ud800"', '"\\ud83d\\ude00"', '"\\x"', '"\n"', "x"]
    rows = ["4501042323994846 Anth heoron", "", " ", "[1,]", '{"a":1,}', "[,]", '{"a":[{}, {"b" : nan}]} ', "{a:1}", "01", "1.", "True", "[" * 5000 + "]" * 5000, "{}\x00"]
    rows += ["".join(r.choices(parts, k=r.randrange(1, 7))) for _ in range(3000)]
    rows += ["[" + ",".join(r.choices(['"k"', "1", "{}", '{"a":-0}', "[]", "", "1 2"], k=3)) + "]" for _ in range(300)]
    want = [duckdb.execute("SELECT coalesce(try_cast(json_valid(?) AS BOOLEAN), false)", [x]).fetchone()[0] for x in rows]
    assert values(spark, [*rows, None], preprocess.is_json(F.col("x"))) == [*want, False]

"""Operators on small tables against plain Python."""

import random

from pyspark.sql import functions as F

from quillspark.operators import editorial, entities, joins, layout, memory, packing, ranking, reimport, termbase, validate, vectors
from quillspark.operators.durable import new_path
from quillspark.sources import interchange


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_numbered_without_gathering(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "a", "a", None]), r.random()) for _ in range(500)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k string, v double, i int")
    got = {x.i: x.n for x in ranking.numbered(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for key in ("a", None):
        order = sorted((v, i) for i, (k, v) in enumerate(data) if k == key)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    assert ranking.numbered(df.limit(0), [], [F.col("v")]).count() == 0


def test_range_join(spark):
    r = random.Random(2)
    spans = [(r.choice("ab"), s, s + r.randrange(40), n) for n in range(40) for s in [r.randrange(200)]]
    points = [(r.choice("abc"), r.randrange(250), n) for n in range(200)]
    p, s = spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(spans, "k string, lo int, hi int, s int")
    want = sorted((b, d) for k, a, b in points for g, lo, hi, d in spans if k == g and lo <= a <= hi)
    assert rows(joins.range_join(p, s, ["k"], "at", "lo", "hi", 16), "p", "s") == want
    inside = {b for b, _ in want}
    assert rows(joins.range_join(p, s, ["k"], "at", "lo", "hi", 16, "left_semi"), "p") == sorted((b,) for b in inside)
    assert rows(joins.range_join(p, s, ["k"], "at", "lo", "hi", 16, "left_anti"), "p") == sorted((b,) for _, _, b in points if b not in inside)
    left = rows(joins.range_join(p, s, ["k"], "at", "lo", "hi", 16, "left"), "p", "s")
    assert len(left) == len(want) + len(points) - len(inside)


def test_as_of(spark):
    r = random.Random(9)
    events = [(r.choice("ab"), x, x) for x in r.sample(range(300), 20)]
    points = [(r.choice("abc"), r.randrange(320), n) for n in range(150)]
    p, e = spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(events, "k string, since int, v int")
    want = sorted((n, max((v for g, s, v in events if g == k and s <= at), default=-1)) for k, at, n in points)
    for size in (1, 16, 1000):
        got = joins.as_of(p, e, ["k"], "at", "since", "v", size)
        assert sorted((x.p, -1 if x.v is None else x.v) for x in got.collect()) == want


def test_packing_loses_nothing(spark):
    r = random.Random(3)
    data = [(k, n, r.choice([1, 5, 9, 40])) for k in range(5) for n in range(1, r.randint(2, 60))]
    df = spark.createDataFrame(data, "k int, n int, w int")
    got = packing.packed(df, ["k"], "n", F.col("w"), 20, max_rows=4)
    assert rows(got, "k", "n", "weight") == sorted(data)
    for b in packing.blocks(got, ["k"], "n", 20).collect():
        assert (b.source <= 20 or b.segments == 1) and b.segments <= 4 and b.oversized == (b.source > 20)
        assert b.preceding == [x for x in (b["first"] - 2, b["first"] - 1) if x > 0]


def test_similar_tokens_misses_no_pair(spark):
    r = random.Random(4)
    sets = lambda n: [(i, r.sample("abcdefghijkl", r.randint(1, 8))) for i in range(n)]
    q, e = sets(60), sets(40)
    for threshold in (0.3, 0.5, 0.65, 1.0):
        found = memory.similar_tokens(spark.createDataFrame(q, "query_id int, tokens array<string>"), spark.createDataFrame(e, "entry_id int, tokens array<string>"), threshold)
        want = sorted((a, b) for a, x in q for b, y in e if len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold)
        assert rows(found, "query_id", "entry_id") == want


def test_funnel(spark):
    e = spark.createDataFrame([(1, "Good morning"), (2, "Good morning there"), (3, "Good morning, friend"), (4, "Nothing alike")], "entry_id int, source string")
    q = spark.createDataFrame([(1, "good morning THERE"), (2, "")], "query_id int, source string")
    hits = sorted(memory.funnel(q, e, fuzzy=0.5).collect(), key=lambda r: r.position)
    assert [(h.entry_id, h.method) for h in hits] == [(2, "exact"), (1, "fuzzy"), (3, "fuzzy")] and hits[0].score == 1.0


def test_memory_report(spark):
    e = spark.createDataFrame([(1, "a  b", "X"), (2, "a b", "x "), (3, "a b", "y"), (4, "c [t]", "d"), (5, "e", "f" * 50)], "entry_id int, source string, target string")
    assert rows(memory.duplicates(e), "source", "entries") == [("a b", 3)]
    assert rows(memory.contradictions(e), "source", "targets", "entries") == [("a b", 2, 3)]
    assert rows(e.where(~memory.tags_survive("source", "target")), "entry_id") == [(4,)]
    assert rows(e.where(~memory.length_sane("source", "target")), "entry_id") == [(5,)]


def test_checks(spark):
    p = spark.createDataFrame(
        [("1", "The cat sat on the warm mat today and slept for long.", "Gatto."), ("2", "Pay 12.5% by 2024-01-31 at https://a.b/c {0}", "Paga"), ("3", "One two three four five", "one two three four five"), ("4", "x", "[[POSS:a]] gattone"), ("5", "he said go home now please", "disse go home now please")],
        "segment_id string, source string, target string",
    )
    found = {(r.segment_id, r.kind) for r in validate.errors(p, ["gattone"], []).collect()}
    assert {("1", "length"), ("2", "numbers"), ("2", "placeholder"), ("3", "target_identical"), ("4", "internal_token"), ("4", "forbidden_term"), ("5", "leftover_english")} <= found
    issues = validate.issues(validate.errors(p, ["gattone"], []))
    assert issues.count() == issues.dropDuplicates(["segment_id", "category", "evidence"]).count()


def test_entities(spark):
    m = spark.createDataFrame([(1, "PROP"), (1, "PROP"), (2, "PRON")], "coref int, prop string")
    assert rows(entities.confidence(m), "coref", "confidence") == [(1, 0.65), (2, round(0.4 / 3 + 0.2, 3))]
    g = spark.createDataFrame([(1, "she", 238), (1, "he", 219), (1, "it", 543), (2, "she", 50), (2, "he", 48)], "coref int, pron string, n long")
    assert rows(entities.gender(g), "coref", "gender") == [(1, "it"), (2, "unknown")]
    c = spark.createDataFrame([(1, "The Moon", 3), (2, "moon", 5), (3, "Sun", 1)], "coref int, canonical string, mentions long")
    assert rows(entities.merged_clusters(c), "name_key", "canonical", "mentions") == [("moon", "moon", 8), ("sun", "Sun", 1)]


def test_terms(spark):
    d = spark.createDataFrame([(1, "The block-2 and libri")], "doc_id int, text string")
    terms = spark.createDataFrame([("block-2", True, "proposed"), ("libro", False, "approved"), ("zoo", True, "approved")], "source_term string, preferred boolean, status string")
    assert rows(termbase.select_terms(d, terms, "doc_id"), "source_term") == [("block-2",)]
    assert rows(termbase.mentions(d, terms, "doc_id"), "source_term", "inside", "as_word", "as_stem") == [("block-2", True, True, True), ("libro", False, False, True), ("zoo", False, False, False)]


def test_nearest_vectors(spark):
    r = random.Random(6)
    v = [(i, r.choice([0, 1]), [r.random() for _ in range(4)]) for i in range(50)]
    df = spark.createDataFrame(v, "id long, g int, v array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)  # noqa: E731, B905
    want = sorted((i, j) for i, g, a in v for j in [j for _, j in sorted((-cos(a, b), j) for j, h, b in v if g == h and j != i)[:3]])
    assert rows(vectors.nearest(df, "id", "v", "g", 3), "id", "other") == want


def test_round_trips(spark):
    odd = [("1:1", "1", 1, "approved", "paragraph", 'He said "hi", <b>&amp;</b>', "a\nb\tc"), ("1:2", "1", 2, "untranslated", "paragraph", " lead and trail ", "é “q” ")]
    u = spark.createDataFrame(odd, "segment_id string, chapter string, ordinal long, status string, kind string, source string, target string")
    for write, read, cols in (
        (interchange.write_csv, interchange.read_csv, ("segment_id", "status", "source", "target")),
        (lambda d, p: interchange.write_tmx(d, p, "en", "it"), interchange.read_tmx, ("segment_id", "source", "target")),
        (lambda d, p: interchange.write_xliff(d, p, "en", "it"), interchange.read_xliff, ("segment_id", "status", "source", "target")),
    ):
        path = new_path(spark, "trip")
        write(u, path)
        assert rows(read(spark, path), *cols) == rows(u, *cols)


def test_term_csv_splits_good_from_bad(spark):
    path = new_path(spark, "terms")
    good = "Rome,Roma,LOCATION,yes,a|b,feminine,singular,,,approved"
    bad = [",x,PERSON,yes,,,,,,", "y,z,PLACE,yes,,,,,,", "w,v,PERSON,maybe,,,,,,"]
    head = "source_term,target_term,term_type,preferred,forbidden_targets,grammatical_gender_target,grammatical_number,inflection_notes,usage_notes,status"
    spark.createDataFrame([("\n".join([head, good, *bad]),)], "value string").coalesce(1).write.text(path)
    ok, wrong = interchange.read_term_csv(spark, path)
    assert rows(ok, "source_term", "preferred") == [("Rome", True)] and ok.first().forbidden_targets == ["a", "b"]
    assert [r.error for r in wrong.collect()] == ["source_term is required", "unknown term_type", "invalid boolean"]


def test_reimport_is_idempotent(spark):
    u = spark.createDataFrame([("1", "a", "approved"), ("2", "b", "in_review"), ("3", None, "untranslated")], "segment_id string, target string, status string")
    i = spark.createDataFrame([("1", "z", "in_review"), ("2", "b", "approved"), ("3", "c", "in_review"), ("4", "d", "in_review"), ("2", "", "in_review")], "segment_id string, target string, status string")
    assert rows(reimport.outcomes(i, u), "segment_id", "outcome") == [("1", "conflict"), ("2", "approved"), ("2", "skipped"), ("3", "updated"), ("4", "not_found")]
    once = reimport.upserted(u, i.where("segment_id = '3'"), "segment_id")
    assert rows(reimport.upserted(once, i.where("segment_id = '3'"), "segment_id"), "segment_id", "target") == rows(once, "segment_id", "target")


def test_ranges_close_before_the_next(spark):
    n = spark.createDataFrame([("s", 1, 20), ("s", 5, 20), ("s", 5, 20), ("s", 9, 20)], "k string, start int, total int")
    assert rows(layout.closed_ranges(n, ["k"], "start", F.col("total")), "start", "end_page") == [(1, 4), (5, 5), (5, 8), (9, 20)]


def test_quote_ends_at_a_line_feed(spark):
    """A side of sixty characters that ends on a line feed takes no word before it."""
    text = "before\n" + "a" * 60 + "th" + "b" * 60 + "\x0bon\u00a0 after"
    df = spark.createDataFrame([(text,)], "text string").select(editorial.quote(F.col("text"), F.instr("text", "th") - 1, F.instr("text", "th") + 1).alias("q"))
    assert df.first().q == "a" * 60 + "th" + "b" * 60 + "\x0bon\u00a0"


def test_overlapping_misses_no_pair(spark):
    """As all pairs, with entries in one block and in several, rows without tokens and sets of many sizes."""
    r = random.Random(4)
    sets = lambda n: [(i, r.sample("abcdefghijkl", r.randint(0, 8))) for i in range(n)]
    q, e = [*sets(60), (60, list("abcdefghijkl"))], sets(40)
    for threshold, block in ((0.3, 512), (0.3, 7), (0.65, 40), (1.0, 1)):
        found = memory.overlapping(spark.createDataFrame(q, "query_id int, tokens array<string>"), spark.createDataFrame(e, "entry_id int, tokens array<string>"), threshold, block)
        want = sorted((a, b, len(set(x) & set(y)) / len(set(x) | set(y))) for a, x in q for b, y in e if x and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold)
        assert rows(found, "query_id", "entry_id", "jaccard") == want


def test_jaccard_pairs_shuffles_nothing(spark):
    from quillspark.catalog import QUERIES

    assert "Exchange" not in QUERIES["jaccard_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_nearest_texts(spark):
    """As nearest() over embedded texts, for the wanted rows, with many copies, empty texts and several blocks."""
    from pyspark.sql import functions as F

    from quillspark.functions import embedding as em

    r = random.Random(8)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(r.randint(1, 6))) for _ in range(150)]
    data = [(i, r.choice("xy"), t) for i, t in enumerate([*texts, *["alpha beta"] * 30, None, "", "!"])]
    df = spark.createDataFrame(r.sample(data, len(data)), "id long, g string, t string").repartition(3)
    want = vectors.nearest(df.select("id", "g", em.embed("t").alias("v")), "id", "v", "g", 3).where("score >= 0.6 and id % 5 = 0")
    for block in (32768, 9):
        assert rows(vectors.nearest_texts(df, "id", "t", "g", F.expr("id % 5 = 0"), 3, 0.6, block), "id", "other", "score") == rows(want, "id", "other", "score")


def test_semantic_turns_by_few_rows(spark):
    """What is shuffled are the best of each query and task, not vectors."""
    from quillspark.catalog import QUERIES

    plan = QUERIES["tm_semantic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "Join" not in plan

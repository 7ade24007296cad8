"""The pipeline's stages against plain restatements, each on its own input."""

import corpus_pipeline as cp
import plain
import public_tokenizers as P
from test_nearcopies import exact

from quillspark.llm import bpe, toxicity


def read(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near copies", "repeated substrings", "benchmark decontamination", "byte-level BPE"]
    stages = [f for _, f in cp.STAGES]

    clean = stages[0](spark, docs, sf)
    toxic = {r.doc_id for r in toxicity.scored(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    before, after = read(docs), read(clean)
    assert after == {i: r for i, r in before.items() if i not in toxic} and clean.columns == docs.columns

    single = stages[1](spark, clean, sf)
    rows = [(i, r.text) for i, r in after.items()]
    kept = {c for _, c in exact(rows)}
    before, after = after, read(single)
    assert after == {i: r for i, r in before.items() if i in kept} and single.columns == docs.columns
    assert len(after) < len(before)

    cut = stages[2](spark, single, sf)
    rows = [(i, r.text) for i, r in after.items()]
    expected = {}
    for (i, n, gone, sha), (_, text) in zip(plain.substring_dedup(rows), rows, strict=True):
        if not gone:
            expected[i] = plain.sha(text.encode())
        elif gone < n:
            expected[i] = sha
    after = read(cut)
    assert {i: plain.sha(r.text.encode()) for i, r in after.items()} == expected
    assert all(r.n_chars == len(r.text) for r in after.values()) and cut.columns == docs.columns

    fair = stages[3](spark, cut, sf)
    bad = {x[0] for x in plain.contamination([(i, r.text) for i, r in after.items()], bench) if x[5]}
    before, after = after, read(fair)
    assert bad and after == {i: r for i, r in before.items() if i not in bad}

    codec = bpe.Codec(bpe.load_ranks(P.path(cp.TOKENIZER)), P.PATTERN)
    final = read(stages[4](spark, fair, sf))
    assert final.keys() == after.keys()
    for i, r in final.items():
        ids = next(iter(codec.encode([after[i].text])))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, plain.sha(ids), plain.sha(after[i].text.encode()))

    assert read(cp.run(spark, sf)) == final


def test_columns_of_operators_names(spark, sf):
    """Columns of documents that have the names operators use come through every stage with their own values."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars")
    own = {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in "score predicted n_words n_removed hits items n_hit n_items contaminated chunk fp component_id kept_id _2_".split()}
    docs = docs.withColumns(own)
    docs = spark.createDataFrame(docs.limit(60).collect(), docs.schema)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in own)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_on_hard_rows(spark, sf):
    """Nulls, empty texts, repeated rows and one very long text go through every stage."""
    like = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (None, "no id here", "en", "s", 10), (4, "the idiot " * 3, "en", "s", 30), (5, "\n\n", "xx", "s", 2)]
    docs = like.limit(50).union(spark.createDataFrame(rows, like.schema))
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), schema=stage(spark, docs, sf).schema)
    ids = [r.doc_id for r in docs.collect()]
    assert None in ids and 3 in ids and len(ids) > 30

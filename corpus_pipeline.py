"""A cleaning pipeline over documents: each stage works on all that the one before kept.

Each stage's result is written as Parquet in the shared folder and read again, so a lost
executor costs a part of one stage. All stages but the last return the columns of documents,
each with the values it came with, whatever its name: an operator sees doc_id, text, and the
others under names that are no operator's. Only cut_repeats changes values, text and n_chars
(where there is such a column) of documents that lose words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, nearcopies, storage, substrings, toxicity

#: the vocabulary of the last stage
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _veiled(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text, and all other columns under names that no operator uses."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_{i}_") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _unveiled(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs as they were, from rows that _veiled() renamed."""
    return found.select(*[F.col(c if c in ("doc_id", "text") else f"_{i}_").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the stage's own input, calls toxic."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _unveiled(toxicity.scored(_veiled(docs), model).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id: pairs whose sets of five-word shingles
    have an exact Jaccard similarity of 0.8 or more."""
    return _unveiled(nearcopies.one_of_each(_veiled(docs), shingle=5), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of runs of 13 that a smaller doc_id holds; what loses all its words goes."""
    kept = substrings.repeats(_veiled(docs)).where("n_removed = 0 or n_removed < n_words")
    out = _unveiled(kept.withColumn("text", F.struct("text", (F.col("n_removed") > 0).alias("cut"))), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text.cut"), F.length("text.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("text.text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a benchmark's passages cover a twentieth or more."""
    return _unveiled(decontaminate.judged(_veiled(docs), _table(spark, sf_dir, "benchmark")).where("not contaminated"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated substrings", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokens),
]
#: SQL can't express the classifier; tests hold the stages against plain restatements
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

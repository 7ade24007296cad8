"""Documents as lines, sentences and segments."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line of each text, with line_no from 1; the text itself is dropped."""
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def sentences(docs: DataFrame, col: str = "text") -> DataFrame:
    """A row for each sentence, with ordinal from 1."""
    keep = [c for c in docs.columns if c != col]
    return docs.select(*keep, F.posexplode(t.sentences(col)).alias("ordinal", "sentence")).withColumn("ordinal", (F.col("ordinal") + 1).cast("long"))


def segment_namespace(name: str = t.SEGMENT_NAMESPACE_NAME) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, name).hex


def segment_id(project: str, chapter: str, ordinal: str, namespace: str = t.SEGMENT_NAMESPACE_NAME) -> Column:
    """Stable id of a segment: the same project, chapter and ordinal give the same one. Give the name that ids
    which exist already were made with to get the same ones."""
    return t.uuid5(segment_namespace(namespace), F.concat_ws(":", project, chapter, ordinal))


def source_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

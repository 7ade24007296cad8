"""Readers and writers of bilingual files: CSV, TMX, XLIFF, TBX. Spark's own formats do the reading and the writing,
so files may lie in any store; a row is a unit, and no file is built on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: status of a segment to state of a unit, and back
STATE = {"untranslated": "initial", "machine_draft": "translated", "in_review": "reviewed", "approved": "final"}
STATUS = {v: k for k, v in STATE.items()} | {"needs-translation": "untranslated", "needs-review": "in_review", "signed-off": "approved"}
CSV_HEADER = ("segment_id", "chapter", "ordinal", "status", "kind", "source", "target")


def mapped(col: Column | str, table: dict[str, str], default: str) -> Column:
    key = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def state_of(status: Column | str) -> Column:
    return mapped(status, STATE, "initial")


def status_of(state: Column | str) -> Column:
    return mapped(state, STATUS, "machine_draft")


def escaped(col: Column | str) -> Column:
    """Text inside an element: marks as references; what XML can't hold is left out. Line feeds as references, to survive readers."""
    x = F.col(col) if isinstance(col, str) else col
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
        x = F.replace(x, F.lit(mark), F.lit(ref))
    return x


def write_csv(units: DataFrame, path: str) -> None:
    """Bilingual CSV with a header, quoted where needed, quotes doubled."""
    units.select(*CSV_HEADER).write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an id, a byte order mark at the front of the first field aside."""
    schema = ", ".join(f"{c} string" for c in CSV_HEADER)
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)
    ident = F.trim(F.regexp_replace("segment_id", "^﻿", ""))
    return df.withColumn("segment_id", ident).where("segment_id <> ''").withColumn("ordinal", F.col("ordinal").try_cast("bigint"))


def _lines(df: DataFrame, head: str, tail: str, path: str) -> None:
    """One file for each partition, each a whole document."""

    def wrap(batches):
        import pyarrow as pa

        rows = [x for b in batches for x in b.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([head + "\n" + "\n".join(rows) + "\n" + tail])], names=["value"])

    df.mapInArrow(wrap, "value string").write.text(path)


def write_tmx(units: DataFrame, path: str, source_lang: str, target_lang: str) -> None:
    """Units with a target, each a tu of two tuv."""
    tu = F.concat(F.lit('<tu tuid="'), escaped("segment_id"), F.lit(f'"><tuv xml:lang="{source_lang}"><seg>'), escaped("source"), F.lit(f'</seg></tuv><tuv xml:lang="{target_lang}"><seg>'), escaped("target"), F.lit("</seg></tuv></tu>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header creationtool="quillspark" creationtoolversion="1" segtype="sentence" o-tmf="none" adminlang="en" srclang="{source_lang}" datatype="plaintext"/><body>'
    _lines(units.where("coalesce(target, '') <> ''").select(tu.alias("value")), head, "</body></tmx>", path)


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, source (of the first tuv), target (of the last other)."""
    schema = "_tuid string, tuv array<struct<`_xml:lang`:string,seg:string>>"
    df = spark.read.format("xml").option("rowTag", "tu").option("ignoreSurroundingSpaces", False).schema(schema).load(path)
    return df.where(F.size("tuv") > 1).select(F.col("_tuid").alias("segment_id"), F.element_at("tuv", 1)["seg"].alias("source"), F.element_at("tuv", -1)["seg"].alias("target"))


def write_xliff(units: DataFrame, path: str, source_lang: str, target_lang: str) -> None:
    unit = F.concat(F.lit('<unit id="'), escaped("segment_id"), F.lit('"><segment state="'), state_of("status"), F.lit('"><source>'), escaped("source"), F.lit("</source><target>"), escaped("target"), F.lit("</target></segment></unit>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0" version="2.1" srcLang="{source_lang}" trgLang="{target_lang}"><file id="f1">'
    _lines(units.select(unit.alias("value")), head, "</file></xliff>", path)


def read_xliff(spark: SparkSession, path: str) -> DataFrame:
    schema = "_id string, segment struct<_state:string,source:string,target:string>"
    df = spark.read.format("xml").option("rowTag", "unit").option("ignoreSurroundingSpaces", False).schema(schema).load(path)
    return df.select(F.col("_id").alias("segment_id"), status_of(F.col("segment._state")).alias("status"), F.col("segment.source").alias("source"), F.col("segment.target").alias("target"))


def write_tbx(terms: DataFrame, path: str, target_lang: str) -> None:
    entry = F.concat(
        F.lit("<termEntry><descrip type=\"subjectField\">"), escaped("term_type"), F.lit('</descrip><langSet xml:lang="en"><tig><term>'), escaped("source_term"),
        F.lit(f'</term></tig></langSet><langSet xml:lang="{target_lang}"><tig><term>'), escaped("target_term"), F.lit('</term><termNote type="administrativeStatus">'), escaped("status"), F.lit("</termNote></tig></langSet></termEntry>"),
    )
    _lines(terms.select(entry.alias("value")), '<?xml version="1.0" encoding="UTF-8"?>\n<martif type="TBX" xml:lang="en"><text><body>', "</body></text></martif>", path)


def read_tbx(spark: SparkSession, path: str) -> DataFrame:
    schema = "descrip struct<_VALUE:string,_type:string>, langSet array<struct<`_xml:lang`:string,tig:struct<term:string,termNote:struct<_VALUE:string,_type:string>>>>"
    df = spark.read.format("xml").option("rowTag", "termEntry").schema(schema).load(path)
    first, last = F.element_at("langSet", 1), F.element_at("langSet", -1)
    return df.select(first["tig"]["term"].alias("source_term"), last["tig"]["term"].alias("target_term"), F.col("descrip._VALUE").alias("term_type"), last["tig"]["termNote"]["_VALUE"].alias("status"))


def read_term_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good terms, rows with their first error) of a termbase CSV."""
    from ..operators import termbase as tb

    df = _read(spark, TERM_FIELDS, path).withColumn("error", tb.row_error())
    good = df.where("error IS NULL").drop("error").withColumns({"preferred": tb.as_boolean("preferred"), "forbidden_targets": tb.as_list("forbidden_targets")})
    return good, df.where("error IS NOT NULL")


TERM_FIELDS = ("source_term", "target_term", "term_type", "preferred", "forbidden_targets", "grammatical_gender_target", "grammatical_number", "inflection_notes", "usage_notes", "status")
#: fixed values: columns of an entity file, and what some may hold
ENTITY_FIELDS = ("canonical_source", "canonical_target", "entity_type", "referential_gender", "grammatical_number", "target_grammatical_gender", "translation_policy", "allow_inflection", "aliases", "definition", "notes", "confidence", "first_page", "mention_count", "status", "gender_evidence", "created_by")


def _written(rows: DataFrame, fields: tuple[str, ...], path: str) -> None:
    """A CSV of the fields, lists joined by bars; those that rows lack are empty."""

    def field(name: str) -> Column:
        if name not in rows.columns:
            return F.lit("").alias(name)
        kind = rows.schema[name].dataType.typeName()
        return (F.array_join(name, "|") if kind == "array" else F.col(name).cast("string")).alias(name)

    rows.select(*map(field, fields)).write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _read(spark: SparkSession, fields: tuple[str, ...], path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{n} string" for n in fields)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_term_csv(terms: DataFrame, path: str) -> None:
    _written(terms, TERM_FIELDS, path)


def write_entity_csv(entities: DataFrame, path: str) -> None:
    _written(entities, ENTITY_FIELDS, path)


def read_entity_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good entities, rows with their first error) of an entity file; a good row doesn't wait for a bad one."""
    from ..operators import termbase as tb

    low = lambda n: F.lower(F.trim(F.coalesce(n, F.lit(""))))
    sure = F.trim("confidence")
    error = (
        F.when(low("canonical_source") == "", "canonical_source is required")
        .when(low("entity_type") == "", "entity_type is required")
        .when(~F.upper(F.trim("entity_type")).isin(*tb.TYPES), "unknown entity_type")
        .when(tb.as_boolean("allow_inflection").isNull(), "invalid boolean")
        .when((low("grammatical_number") != "") & ~low("grammatical_number").isin(*tb.NUMBERS), "invalid number")
        .when((low("target_grammatical_gender") != "") & ~low("target_grammatical_gender").isin(*tb.GENDERS), "invalid gender")
        .when((low("status") != "") & ~low("status").isin(*tb.STATUSES), "unknown status")
        .when((F.coalesce(sure, F.lit("")) != "") & ~F.coalesce(sure.try_cast("double").between(0, 1), F.lit(False)), "confidence out of range")
    )
    df = _read(spark, ENTITY_FIELDS, path).withColumn("error", error)
    good = df.where("error IS NULL").drop("error").withColumns({"aliases": tb.as_list("aliases"), "allow_inflection": tb.as_boolean("allow_inflection"), "confidence": sure.try_cast("double")})
    return good, df.where("error IS NOT NULL")


def read_entity_table(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of a tab-separated entity table of a book parser: rows with too few columns are left out."""
    schema = "COREF int, start_token int, end_token int, prop string, cat string, text string"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("mode", "DROPMALFORMED").csv(path).where("COREF IS NOT NULL AND text IS NOT NULL")


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of a TSV of layout levels: level 5, confidence of zero or more, some text."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, `left` int, top int, width int, height int, conf double, text string"
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return df.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def leaked(spark: SparkSession, path: str, canaries: list[str]) -> DataFrame:
    """Log records (JSON lines) that hold a text that must not be logged."""
    logs = spark.read.text(path)
    return logs.where(F.exists(F.array(*map(F.lit, canaries)), lambda x: F.col("value").contains(x)))


def html_paragraphs(units: DataFrame) -> DataFrame:
    """A paragraph element for each unit: its target, or its source marked as a draft."""
    draft = F.coalesce("target", F.lit("")) == ""
    css = F.when(F.col("kind").isin("scene_break", "epigraph"), "centred").otherwise("body")
    return units.select("segment_id", F.concat(F.lit('<p class="'), css, F.when(draft, F.lit(" draft")).otherwise(F.lit("")), F.lit('">'), escaped(F.when(draft, F.col("source")).otherwise(F.col("target"))), F.lit("</p>")).alias("html"))

"""A training-corpus pipeline over ``documents``; a part of lectern.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame that is written and read again as the next one's
docs.  All but the last return the columns of ``documents``.

Defined results: null, empty and blank texts fail the rules of the first stage (few words).
Null ids, languages and sources are values like any other, but rows without an id are no
one's near duplicate.  Rows that repeat an earlier one lose their text in the second stage and go; the
row of least id of a group of near copies stays, and all rows of that id.  Columns beside those of
``documents`` keep their values through the first four stages, whatever their names (those
starting ``_`` are reserved).  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, near_dup, rules, sentencepiece
from lectern.llm.arrowmap import discard_others, persisted, scratch, shared_dir


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns and all others in one, so an operator's columns meet no name of theirs."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*rest).alias("_rest")) if rest else docs


def _together(df: DataFrame, columns: list[str], *used: str):
    return df.select(*(F.col(c) if c in used else F.col("_rest")[c].alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    return _together(rules.apply_policy(rules.ledger(_apart(docs, "text")), rules.STANDARD), docs.columns, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that occurred before; documents of which nothing is left go."""
    left = line_dedup.dedup(_apart(docs, "doc_id", "text")).where("n_removed = 0 or n_removed < n_lines")
    whole = _together(left, docs.columns, "doc_id", "text")
    return whole.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else whole


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates, and all others."""
    gone = near_dup.classes(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts."""
    return sentencepiece.encode(docs, ["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix_sources", mix), ("sentencepiece", encode)]
# SQL expresses neither the hashes that select and mix nor the encoding; tests/llm/test_queries.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage read and wrote on its way goes once its result is written."""
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = persisted(stage(spark, docs, sf_dir), folder, name)
        discard_others(spark, folder, [name])
    return STAGES[-1][1](spark, docs, sf_dir)

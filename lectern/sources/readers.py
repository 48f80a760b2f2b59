"""Readers of the texts that surround a catalogue: annotations, notes, call logs, saved searches, tool listings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = "struct<id:bigint,book_id:bigint,format:string,annotation:struct<type:string,title:string,highlighted_text:string,notes:string,timestamp:string>,text:string,type:string,notes:string,timestamp:string>"


def first_value(text: str) -> str | None:
    """The first JSON list or object in a text, whatever stands around it; None if there is no whole one."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            _, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return text[m.start() : end]
    return None


@F.pandas_udf(T.StringType())
def _first_json(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else first_value(t)).astype(object)


def annotations(lines: DataFrame, column: str = "value") -> DataFrame:
    """(book_id, kind, text, notes, ts): annotation rows of the first JSON value in each text; nested and flat shapes, a list or an export's object."""
    value = _first_json(column)
    exported = F.from_json(value, f"struct<annotations:array<{ANNOTATION}>>")["annotations"]
    listed = F.when(value.startswith("["), F.from_json(value, f"array<{ANNOTATION}>")).otherwise(exported)
    rows = lines.select(F.explode(listed).alias("a"))
    pick = lambda *c: F.coalesce(*(F.col(f"a.{x}") for x in c))
    return rows.select(F.col("a.book_id").alias("book_id"), pick("annotation.type", "type").alias("kind"), pick("annotation.highlighted_text", "text").alias("text"), pick("annotation.notes", "notes").alias("notes"), pick("annotation.timestamp", "timestamp").alias("ts"))


def notes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(field, item, snippet) of tab-separated rows of three columns or more; further tabs belong to the snippet."""
    parts = F.split(column, "\t", 3)
    return lines.where(F.size(parts) >= 3).select(parts[0].alias("field"), parts[1].alias("item"), parts[2].alias("snippet"))


def call_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; torn lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def saved_searches(lines: DataFrame, number: str, column: str = "value") -> DataFrame:
    """(name, expression) of one tool's listing: a name line, then its search line; a name alone gives nothing. A listing is short, so one task orders it."""
    name = F.regexp_extract(column, r"^\s*Name:\s*(.*\S)", 1)
    search = F.regexp_extract(column, r"^\s*Search string:\s*(.*\S)", 1)
    tagged = lines.select(F.col(number).alias("n"), F.nullif(name, F.lit("")).alias("name"), F.nullif(search, F.lit("")).alias("expression")).where("name is not null or expression is not null")
    before = F.lag("name").over(Window.orderBy("n"))
    return tagged.withColumn("before", before).where("expression is not null and before is not null").select(F.col("before").alias("name"), "expression")


def image_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """(page, number, kind, width, height, x_ppi, y_ppi) of a raster listing; resolutions are read from the row's end."""
    p = F.filter(F.split(F.btrim(column), r"\s+"), lambda x: x != "")
    rows = lines.where(F.get(p, 0).rlike(r"^\d+$") & (F.size(p) >= 14))
    return rows.select(F.get(p, 0).cast("int").alias("page"), F.get(p, 1).cast("int").alias("number"), F.get(p, 2).alias("kind"), F.get(p, 3).cast("int").alias("width"), F.get(p, 4).cast("int").alias("height"), F.element_at(p, -4).cast("int").alias("x_ppi"), F.element_at(p, -3).cast("int").alias("y_ppi"))


def documents(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, modified, text) of binary files through a pluggable extractor: a function from bytes and path to text."""
    @F.pandas_udf("string")
    def text(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([extract(c, n) for c, n in zip(content, name)])

    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), text("content", "path").alias("text"))

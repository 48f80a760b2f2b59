"""The mix is one multiset, however its rows are partitioned."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


def rows(spark, kind):
    """Rows that hash alike: equal text and no id, one of two values missing; or maps that differ."""
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2 == 0).alias("first"), F.col("id"))
    a, b = F.when(F.col("first"), F.lit("x")), F.when(~F.col("first"), F.lit("x"))
    if kind == "nulls":
        df = df.select("doc_id", "text", "source", a.alias("a"), b.alias("b"))
    elif kind == "nested":
        df = df.select("doc_id", "text", "source", F.struct(a.alias("a"), b.alias("b")).alias("s"), F.array(a, b).alias("r"))
    else:
        m = F.when(F.col("first"), F.create_map(F.lit("k"), F.lit(1), F.lit("l"), F.lit(2))).otherwise(F.create_map(F.lit("l"), F.lit(3), F.lit("k"), F.lit(1)))
        df = df.select("doc_id", "text", "source", m.alias("m"), F.struct(m.alias("m")).alias("s"), F.array(m).alias("r"), F.parse_json(F.to_json(m)).alias("v"))
    return df.unionByName(df.limit(1).withColumn("source", F.lit("t")).withColumn("text", F.lit(" ".join(["w"] * 700))))


@pytest.mark.parametrize("kind", ["nulls", "nested", "maps"])
def test_repeatable(spark, kind, tmp_path):
    rows(spark, kind).write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    found = []
    for n in (1, 3, 7):
        out = mixing.emitted(stored.repartition(n)).drop("v")
        found.append(Counter(map(str, out.collect())))
    assert found[0] == found[1] == found[2] and 0 < sum(found[0].values()) < 4002

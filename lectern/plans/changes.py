"""Queries over records in versions and streams that run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.records import Edit, Records
from lectern.streaming import pipelines

from .tables import scratch_folder, table

FIRST, SECOND = 400, 300


def bulk_update(spark, sf_dir):
    """All parts as records, after two bulk updates (one based on a version that another writer has changed since) and a revert of some."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.array("p_type", F.lit("Shelf")).alias("tags"), F.create_map(F.lit("isbn"), F.col("p_partkey").cast("string")).alias("identifiers"))
    records = Records(spark, scratch_folder(spark, "records"))
    seen = records.put(p)
    chosen = lambda n: p.orderBy("id").limit(n).select("id")
    # Another writer changes every third of them, and the titles of every fifth.
    records.put(records.read().where("id % 3 = 0").withColumn("publisher", F.lit("Other")).withColumn("title", F.when(F.col("id") % 5 == 0, "Renamed").otherwise(F.col("title"))))
    _, outcomes = records.update(chosen(FIRST), Edit({"publisher": "House"}), base=seen)
    at = records.table.snapshot()
    records.update(chosen(SECOND), Edit({}, tags_add=("SHELF", "New"), tags_remove=("new shelf",), identifiers={"ISBN": None, "doi": "10.1/x"}))
    records.revert(at.number, chosen(SECOND).where("id % 4 = 0"))
    rows = records.read().join(outcomes, "id", "left")
    return rows.select("id", "title", "publisher", F.array_join("tags", "|").alias("tags"), F.to_json(F.array_sort(F.map_entries("identifiers"))).alias("identifiers"), "outcome")


def recent_errors(spark, sf_dir):
    """Events as errors of processes (their types), in three files of consecutive times, as a stream: each process's last 20 different ones."""
    folder = scratch_folder(spark, "errors")
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 60).alias("code"), "ts")
    bounds = e.agg(F.expr("percentile_approx(ts, array(0.33, 0.66), 10000)").alias("b")).first().b
    part = F.when(F.col("ts") <= F.lit(bounds[0]), 0).when(F.col("ts") <= F.lit(bounds[1]), 1).otherwise(2)
    for i in range(3):
        e.where(part == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        found = pipelines.recent_errors(stream, "event_type", ["code"], "ts")
        write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch-{n:06d}")
        found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(f"{folder}/out/*")
    last = out.groupBy("event_type").agg(F.max("batch").alias("batch"))
    return out.join(last, ["event_type", "batch"]).select("event_type", "place", "code", "n", "first", "last")


QUERIES = {f.__name__: f for f in (bulk_update, recent_errors)}

ORACLE_SQL = {
    "bulk_update": f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS k FROM part),
 u AS (SELECT p_partkey AS id, k, p_name, p_brand, p_type, p_partkey % 3 = 0 AS other, k <= {SECOND} AND p_partkey % 4 <> 0 AS second FROM p)
 SELECT id, CASE WHEN other AND id % 5 = 0 THEN 'Renamed' ELSE p_name END AS title, CASE WHEN other THEN 'Other' WHEN k <= {FIRST} THEN 'House' ELSE p_brand END AS publisher,
  p_type || '|Shelf' || CASE WHEN second THEN '|New' ELSE '' END AS tags, CASE WHEN second THEN '[{{"key":"doi","value":"10.1/x"}}]' ELSE '[{{"key":"isbn","value":"' || id || '"}}]' END AS identifiers,
  CASE WHEN k <= {FIRST} THEN CASE WHEN other THEN 'foreign' ELSE 'written' END END AS outcome FROM u""",
    # An error goes from the ring when 20 others came since it last did; it then begins anew.
    "recent_errors": """WITH e AS (SELECT event_type, user_id % 60 AS code, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id % 60) AS i FROM events),
 g AS (SELECT *, lag(i) OVER (PARTITION BY event_type, code ORDER BY i) AS p FROM e),
 r AS (SELECT g.*, p IS NULL OR (SELECT count(DISTINCT x.code) FROM e x WHERE x.event_type = g.event_type AND x.i > g.p AND x.i < g.i) >= 20 AS anew FROM g),
 n AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, code ORDER BY i) AS run FROM r),
 a AS (SELECT event_type, code, run, count(*) AS n, min(ts) AS first, max(ts) AS last, max(i) AS i FROM n GROUP BY ALL),
 l AS (SELECT *, row_number() OVER (PARTITION BY event_type, code ORDER BY run DESC) AS k FROM a)
 SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS INT) AS place, code, n, first, last FROM l WHERE k = 1 QUALIFY place <= 20""",
}

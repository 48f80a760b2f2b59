"""The driver's tables, and a folder for what queries store on their way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; below the warehouse in local sessions without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lectern"
    return f"{root.rstrip('/')}/plans-{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores; for narrow rows from which much more is made, as their few bytes make few tasks.

    The number of parts is given, or Spark would join small ones again.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)

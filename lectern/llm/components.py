"""Connected components of link tables, as joins and partial aggregates only."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import persisted


def components(links: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """(v, root): for each end of a link (a, b: long), the smallest id reachable from it.

    Each round, every vertex takes the least label among its neighbours' and its
    own, then the label of that label (pointer jumping).  Rounds end when no
    label changes, which labels that only fall ensure; each is written to the shared folder, so a lost executor costs
    one round at most.  Links of one hub meet in a partial aggregate, or in a join
    that adaptive execution splits.
    """
    both = persisted(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), folder, f"{name}-links")
    labels = persisted(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), folder, f"{name}-0")
    for i in itertools.count(1):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("next"))
        moved = persisted(stepped.join(jump, "root", "left").select("v", "old", F.least("root", "next").alias("root")), folder, f"{name}-{i}")
        labels = moved.select("v", "root")
        if moved.where("root <> old").isEmpty():
            return labels

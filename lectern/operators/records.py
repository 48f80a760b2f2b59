"""Catalogue records in versions: previews, bulk updates that do not lose another writer's changes, history and revert."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merging
from .segments import Conflict, Snapshot, Table

MOST = 500


@dataclass(frozen=True)
class Edit:
    """What to do to each record: fields to set, tags to add and remove, identifiers to set (null: remove).

    Values are columns over the record or plain values; tags and identifiers are merged with what a record has.
    """

    fields: dict[str, object]
    tags_add: tuple[str, ...] = ()
    tags_remove: tuple[str, ...] = ()
    identifiers: dict[str, str | None] | None = None

    def applied(self, rows: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        out = {c: (v if isinstance(v, Column) else F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).cast(kinds[c]) for c, v in self.fields.items()}
        if self.tags_add or self.tags_remove:
            if "tags" in self.fields:
                raise ValueError("tags are either set or merged")
            names = lambda t: F.array(*map(F.lit, t)).cast("array<string>")
            out["tags"] = merging.merged_tags("tags", names(self.tags_add), names(self.tags_remove))
        if self.identifiers:
            pairs = [F.lit(x) for kv in self.identifiers.items() for x in kv]
            out["identifiers"] = merging.merged_identifiers(F.col("identifiers"), F.create_map(*pairs).cast("map<string,string>"))
        return rows.withColumns(out)

    @property
    def touched(self) -> list[str]:
        return [*self.fields, *(["tags"] if self.tags_add or self.tags_remove else []), *(["identifiers"] if self.identifiers else [])]


class Records:
    """A versioned table of records, one row for each key; an update rewrites the records that it changes."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.key, self.table = key, Table(spark, folder, key)

    def put(self, rows: DataFrame, removed: DataFrame | None = None) -> Snapshot:
        return self.table.commit({"records": rows}, removed)

    def read(self, at: Snapshot | None = None) -> DataFrame:
        return self.table.read("records", at)

    def preview(self, ids: DataFrame, edit: Edit, at: Snapshot | None = None) -> DataFrame:
        """(key, field, before, after) of what an update would change."""
        rows = self.read(at).join(ids.select(self.key).distinct(), self.key, "left_semi")
        return merging.changes(rows, edit.applied(rows), self.key, edit.touched).where("changed").drop("changed")

    def update(self, ids: DataFrame, edit: Edit, base: Snapshot | None = None, most: int = MOST, attempts: int = 5) -> tuple[Snapshot, DataFrame]:
        """The new snapshot, and (key, outcome): written, landed (it was there already), foreign (another writer's value stays), missing.

        The edit is what was previewed on ``base``.  A record in which a touched field has got a third value since
        is left alone; changes of its other fields are kept.  If another commit comes first, it is looked at, and the rest tried again.
        """
        wanted = ids.select(self.key).distinct()
        if (n := wanted.limit(most + 1).count()) > most:
            raise ValueError(f"over {most} records in one update")
        base = base or self.table.snapshot()
        old = self.read(base).join(wanted, self.key, "left_semi")
        for left in range(attempts, 0, -1):
            at = self.table.snapshot()
            now = self.read(at).join(wanted, self.key, "left_semi")
            seen = merging.landed(edit.applied(old), old, now, self.key, edit.touched)
            by_field = seen.groupBy(self.key).agg(F.max((F.col("outcome") == "foreign").cast("int")).alias("_f"), F.min((F.col("outcome") == "landed").cast("int")).alias("_l"))
            here = wanted.join(now.select(self.key, F.lit(True).alias("_now")), self.key, "left").join(by_field, self.key, "left")
            outcome = F.when(F.col("_now").isNull(), "missing").when(F.col("_f").isNull() | (F.col("_f") == 1), "foreign").when(F.col("_l") == 1, "landed").otherwise("written")
            # At most ``most`` rows.
            rows = [(r[self.key], r.outcome) for r in here.select(self.key, outcome.alias("outcome")).collect()]
            outcomes = self.table.spark.createDataFrame(rows, f"{self.key} {ids.schema[self.key].dataType.simpleString()}, outcome string")
            if n == 0 or not any(o == "written" for _, o in rows):
                return at, outcomes
            changed = now.join(outcomes.where("outcome = 'written'").select(self.key), self.key, "left_semi")
            merged = changed.join(edit.applied(old).select(self.key, *(F.col(c).alias(f"_{i}") for i, c in enumerate(edit.touched))), self.key)
            new = merged.select(*(F.col(f"_{edit.touched.index(c)}").alias(c) if c in edit.touched else F.col(c) for c in now.columns))
            try:
                return self.table.commit({"records": new}, base=at), outcomes
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def revert(self, to: int, ids: DataFrame | None = None) -> Snapshot:
        """All records as they were in a snapshot, or those of some keys; keys that it did not have are removed."""
        if ids is None:
            return self.table.revert(to)
        at = self.table.snapshot(to)
        wanted = ids.select(self.key).distinct()
        then = self.read(at).join(wanted, self.key, "left_semi")
        return self.put(then, wanted.join(then.select(self.key), self.key, "left_anti"))

    def history(self, ids: DataFrame, fields: Sequence[str]) -> DataFrame:
        """(key, version, fields) of each version of records in which one of the fields is another than in the version before."""
        from pyspark.sql import Window

        wanted = ids.select(self.key).distinct()
        parts = [self.read(at).join(wanted, self.key, "left_semi").select(self.key, F.lit(n).alias("version"), *fields) for n in self.table.numbers() if (at := self.table.snapshot(n)).segments]
        every = reduce(DataFrame.unionByName, parts)
        kinds = dict(every.dtypes)
        marks = F.struct(*(merging.canonical(f, kinds[f]) for f in fields))
        before = F.lag(marks).over(Window.partitionBy(self.key).orderBy("version"))
        return every.withColumn("_new", before.isNull() | ~marks.eqNullSafe(before)).where("_new").drop("_new")

"""Tables in segments: a commit writes what changed, and nothing that did not.

A folder holds segments (one Parquet folder for each table), graves and snapshots.  A
commit replaces all rows of some keys: it writes their new rows as one segment, and the
keys as a grave, which hides the rows that older segments hold of them; a key that is
removed has a grave only.  A snapshot is a small JSON file that names what is live: it
is written last and never over another, so a commit that meets a newer snapshot than the one
it began from fails (``Conflict``) and leaves the table as it was, and a reader keeps the
snapshot it has.  ``merge`` rewrites segments of like size into one, without hidden rows,
so a table has few segments and each row is rewritten a logarithmic number of times.
A grave may name the tables that it holds for, so a key's row in a small table changes without its large ones.
Tables with a layout come sorted in runs and are written as they come, without a shuffle; so their terms are stored by
what differs from the term before.

Rows of a null key can't be replaced, so they are refused.  Files that no snapshot names stay
until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
# Keys in graves up to which they are sent to all executors (some 32 MB); more are shuffled with the rows.
GRAVES = 1 << 21


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Segment:
    """``main`` is the table that has a row for each key; ``rows`` counts it.  A grave holds for the tables in ``only``, or for all."""

    name: str
    gen: int
    rows: int
    main: str = ""
    only: tuple[str, ...] = ()


@dataclass(frozen=True)
class Snapshot:
    """Live segments and graves; ``facts`` are numbers that its commits add up, ``batches`` the last batch of each stream."""

    number: int
    segments: tuple[Segment, ...] = ()
    graves: tuple[Segment, ...] = ()
    facts: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str) -> Snapshot:
        d = json.loads(text)
        return cls(d["number"], *(tuple(Segment(**s | {"only": tuple(s.get("only", ()))}) for s in d[k]) for k in ("segments", "graves")), d["facts"], d["batches"])


NOTHING = Snapshot(0)


class Table:
    """Tables of one folder that share a key column; ``layout`` names the columns by which a table's rows come sorted in runs."""

    def __init__(self, spark: SparkSession, folder: str, key: str, layout: dict[str, Sequence[str]] | None = None):
        self.spark, self.folder, self.key, self.layout = spark, folder.rstrip("/"), key, layout or {}

    # Files.

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _listed(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("snapshots") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest snapshot that was written whole, or that of a number; an empty one if there is none."""
        for n in [number] if number is not None else reversed(self.numbers()):
            try:
                return Snapshot.of(self._read(f"snapshots/{n:012d}.json"))
            except (ValueError, KeyError):  # a commit that died while it wrote
                if number is not None:
                    raise
        return NOTHING

    def _publish(self, snapshot: Snapshot) -> Snapshot:
        fs, path = self._at(f"snapshots/{snapshot.number:012d}.json")
        from py4j.protocol import Py4JJavaError

        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "exists" not in str(e.java_exception):
                raise
            raise Conflict(f"snapshot {snapshot.number} of {self.folder} is there already") from e
        out.write(bytearray(json.dumps(asdict(snapshot)).encode()))
        out.close()
        return snapshot

    def repair(self) -> None:
        """Removes snapshots that a commit which died left half-written; no other writer may be at work."""
        for n in self.numbers():
            try:
                self.snapshot(n)
            except (ValueError, KeyError):
                fs, path = self._at(f"snapshots/{n:012d}.json")
                fs.delete(path, False)

    # Reading.

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        """Live rows of a table; segments that no grave follows are read without looking for any."""
        at = at or self.snapshot()
        if not at.segments:
            raise ValueError(f"{self.folder} holds nothing yet")
        return reduce(DataFrame.unionByName, self._live(name, at.segments, at.graves))

    def _live(self, name: str, segments: Sequence[Segment], graves: Sequence[Segment]) -> list[DataFrame]:
        graves = [g for g in graves if not g.only or name in g.only]
        last, parts, old = max((g.gen for g in graves), default=-1), [], []
        for s in segments:
            rows = self.spark.read.parquet(f"{self.folder}/segments/{s.name}/{name}")
            if s.gen >= last:
                parts.append(rows)
            else:
                old.append(rows.withColumn("_gen", F.lit(s.gen)))
        if old:
            hidden = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.folder}/graves/{g.name}").withColumn("_from", F.lit(g.gen)) for g in graves))
            if self._few(graves):
                hidden = F.broadcast(hidden)
            rows = reduce(DataFrame.unionByName, old)
            parts.append(rows.join(hidden.withColumnRenamed(self.key, "_key"), (F.col(self.key) == F.col("_key")) & (F.col("_gen") < F.col("_from")), "left_anti").drop("_gen"))
        return parts

    @staticmethod
    def _few(graves: Sequence[Segment]) -> bool:
        return sum(g.rows for g in graves) <= GRAVES

    # Writing.

    def _write(self, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], gen: int, count: str, mixed: bool = False) -> Segment:
        """One segment; rows of a layout that a join has ``mixed`` are sorted again, each task's by themselves.

        A table may be a function of a reader of those written before it; these are written first.
        """
        name = uuid.uuid4().hex[:16]
        written = lambda table: self.spark.read.parquet(f"{self.folder}/segments/{name}/{table}")
        for table, made in sorted(tables.items(), key=lambda x: callable(x[1])):
            df, by = made(written) if callable(made) else made, self.layout.get(table)
            laid = df.sortWithinPartitions(*by, self.key) if by and mixed else df
            writer = laid.write.option("parquet.block.size", 8 << 20).option("compression", "zstd")
            if by:
                writer = writer.option("parquet.writer.version", "v2")
                for c in (by[0], self.key):
                    writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
            writer.parquet(f"{self.folder}/segments/{name}/{table}")
        return Segment(name, gen, written(count).count(), count)

    def commit(self, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]] | None = None, removed: DataFrame | None = None, facts: Callable[[Snapshot, Segment | None, DataFrame], dict[str, int]] | None = None, base: Snapshot | None = None, batch: tuple[str, int] | None = None, partly: DataFrame | None = None) -> Snapshot:
        """Replaces all rows of the keys in ``tables`` (the first of them has a row for each key) and removes those of ``removed``.

        Of the keys in ``partly`` only the row of the first table is new; what older segments hold of them in other tables stays.

        ``facts`` gives the new facts from the old snapshot, the new segment and the keys touched.  A ``batch`` (stream,
        number) that is in already changes nothing, so a stream may repeat it.
        """
        base = base or self.snapshot()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        gen, segment, keys = base.number + 1, None, []
        if tables:
            first = next(iter(tables))
            segment = self._write(tables, gen, first)
            keys.append(self.spark.read.parquet(f"{self.folder}/segments/{segment.name}/{first}").select(self.key))
            if keys[0].where(F.col(self.key).isNull()).limit(1).count():
                raise ValueError(f"rows without {self.key}")
            if partly is not None:
                keys[0] = keys[0].join(partly.select(self.key), self.key, "left_anti")
        if removed is not None:
            keys.append(removed.select(self.key).where(F.col(self.key).isNotNull()))
        touched = reduce(DataFrame.unionByName, keys).distinct() if keys else None
        graves = base.graves
        if touched is not None and (base.segments or removed is not None):
            graves = (*graves, self._dug(touched, gen))
            touched = self.spark.read.parquet(f"{self.folder}/graves/{graves[-1].name}")
            if partly is not None:
                graves = (*graves, self._dug(partly.select(self.key).distinct(), gen, (first,)))
        known = facts(base, segment, touched) if facts and touched is not None else base.facts
        segments = (*base.segments, segment) if segment and segment.rows else base.segments
        return self._publish(Snapshot(gen, segments, graves if segments else (), known, base.batches | dict([batch] if batch else [])))

    def _dug(self, keys: DataFrame, gen: int, only: tuple[str, ...] = ()) -> Segment:
        name = uuid.uuid4().hex[:16]
        keys.write.parquet(f"{self.folder}/graves/{name}")
        return Segment(name, gen, self.spark.read.parquet(f"{self.folder}/graves/{name}").count(), only=only)

    def merge(self, fanout: int = FANOUT, everything: bool = False) -> Snapshot:
        """Rewrites ``fanout`` or more segments of one size class as one, until no class has so many; or all, with ``everything``."""
        at = self.snapshot()
        while True:
            classes: dict[int, list[Segment]] = {}
            for s in at.segments:
                classes.setdefault(0 if everything else int(log(max(s.rows, 1), fanout)), []).append(s)
            full = [c for c in classes.values() if len(c) >= (2 if everything else fanout)]
            if not full and not (everything and at.graves):
                return at
            chosen = full[0] if full else list(at.segments)
            names = [n for n in self._listed(f"segments/{chosen[0].name}") if not n.startswith((".", "_"))]
            live = {n: reduce(DataFrame.unionByName, self._live(n, chosen, at.graves)) for n in names}
            # The merged rows outlived all graves so far; later ones still hide them.
            merged = self._write(live, at.number, chosen[0].main, not self._few(at.graves))
            rest = tuple(s for s in at.segments if s not in chosen)
            # Its rows in the main table may all be hidden while those in others live.
            holds = merged.rows or any(not self.spark.read.parquet(f"{self.folder}/segments/{merged.name}/{n}").isEmpty() for n in names)
            segments = (*rest, merged) if holds else rest
            oldest = min((s.gen for s in segments), default=at.number)
            at = self._publish(replace(at, number=at.number + 1, segments=segments, graves=tuple(g for g in at.graves if g.gen > oldest)))

    def revert(self, number: int) -> Snapshot:
        """A new snapshot of what an older one had; the streams' batches stay, as those rows are not sent again."""
        now = self.snapshot()
        return self._publish(replace(self.snapshot(number), number=now.number + 1, batches=now.batches))

    def vacuum(self, keep: int = 1) -> None:
        """Removes what none of the last ``keep`` snapshots names."""
        last = [self.snapshot(n) for n in self.numbers()[-max(keep, 1) :]]
        named = {("segments", s.name) for at in last for s in at.segments} | {("graves", g.name) for at in last for g in at.graves}
        for kind in ("segments", "graves"):
            for name in self._listed(kind):
                if (kind, name) not in named:
                    fs, path = self._at(f"{kind}/{name}")
                    fs.delete(path, True)
        for n in self.numbers()[: -max(keep, 1)]:
            fs, path = self._at(f"snapshots/{n:012d}.json")
            fs.delete(path, False)

"""Versioned records, reranking that fails, opened hits, and the ring of recent errors."""

import random
from datetime import datetime, timedelta

import pytest

from lectern.operators import fusion, logs
from lectern.operators.records import Edit, Records
from lectern.streaming import pipelines

SCHEMA = "id long, title string, publisher string, tags array<string>, identifiers map<string,string>"


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def table(spark, path, n=6):
    r = Records(spark, str(path))
    r.put(spark.createDataFrame([(i, f"t{i}", None, ["Old", "x"], {"isbn": str(i)}) for i in range(n)], SCHEMA))
    return r


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def test_preview_and_update(spark, tmp_path):
    r = table(spark, tmp_path / "r")
    edit = Edit({"publisher": "P"}, tags_add=("old", "New"), tags_remove=("X",), identifiers={"ISBN": None, "doi": "d"})
    got = {(x.id, x.field): (x.before, x.after) for x in r.preview(ids(spark, 1, 1, 99), edit).collect()}
    assert set(got) == {(1, "publisher"), (1, "tags"), (1, "identifiers")} and got[1, "publisher"] == (None, "P")
    _, out = r.update(ids(spark, 1, 2, 99), edit)
    assert by_id(out, "outcome") == {1: ("written",), 2: ("written",), 99: ("missing",)}
    rows = by_id(r.read(), "title", "publisher", "tags", "identifiers")
    assert rows[1] == ("t1", "P", ["Old", "New"], {"doi": "d"}) and rows[0] == ("t0", None, ["Old", "x"], {"isbn": "0"}) and len(rows) == 6
    before = r.table.snapshot().number
    _, out = r.update(ids(spark, 1), edit)
    assert by_id(out, "outcome") == {1: ("landed",)} and r.table.snapshot().number == before
    with pytest.raises(ValueError):
        r.update(ids(spark, 1, 2, 3), edit, most=2)
    with pytest.raises(ValueError):
        r.update(ids(spark, 1), Edit({"tags": ["a"]}, tags_add=("b",)))


def test_other_writers_changes_stay(spark, tmp_path):
    r = table(spark, tmp_path / "r")
    seen = r.table.snapshot()
    r.update(ids(spark, 1), Edit({"publisher": "Other"}))
    r.update(ids(spark, 2), Edit({"title": "Renamed"}))
    r.update(ids(spark, 3), Edit({"publisher": "Mine"}))
    r.put(r.read().where("id = 0"), ids(spark, 4))
    _, out = r.update(ids(spark, 0, 1, 2, 3, 4), Edit({"publisher": "Mine"}), base=seen)
    assert by_id(out, "outcome") == {0: ("written",), 1: ("foreign",), 2: ("written",), 3: ("landed",), 4: ("missing",)}
    assert by_id(r.read(), "title", "publisher") == {0: ("t0", "Mine"), 1: ("t1", "Other"), 2: ("Renamed", "Mine"), 3: ("t3", "Mine"), 5: ("t5", None)}


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    r, raced = table(spark, tmp_path / "r"), []
    commit = type(r.table).commit

    def racing(self, *a, **k):
        if not raced:
            raced.append(1)
            commit(self, {"records": r.read().where("id = 1").selectExpr("id", "title", "'Theirs' as publisher", "tags", "identifiers")})
        return commit(self, *a, **k)

    monkeypatch.setattr(type(r.table), "commit", racing)
    _, out = r.update(ids(spark, 1, 2), Edit({"publisher": "Mine"}))
    assert by_id(out, "outcome") == {1: ("foreign",), 2: ("written",)} and by_id(r.read(), "publisher")[1] == ("Theirs",)


def test_history_and_revert(spark, tmp_path):
    r = table(spark, tmp_path / "r")
    r.update(ids(spark, 1, 2), Edit({"title": "New"}))
    r.update(ids(spark, 2), Edit({"title": "Newer"}))
    r.put(spark.createDataFrame([(7, "seven", None, None, None)], SCHEMA))
    assert [(x.version, x.title) for x in r.history(ids(spark, 2), ["title"]).orderBy("version").collect()] == [(1, "t2"), (2, "New"), (3, "Newer")]
    r.revert(1, ids(spark, 2, 7))
    assert by_id(r.read(), "title") == {0: ("t0",), 1: ("New",), 2: ("t2",), 3: ("t3",), 4: ("t4",), 5: ("t5",)}
    r.revert(3)
    assert by_id(r.read(), "title")[2] == ("Newer",)


def test_a_reranker_may_fail_anywhere(spark):
    pool = spark.createDataFrame([(i, 1.0 / i, f"text {i}", None, "weak" if i == 1 else "body") for i in range(1, 6)], "id int, fused double, text string, alt_text string, tier string")

    def scorer(query, texts):
        if texts[0] == "text 4":
            raise RuntimeError("out of memory")
        return [len(texts[0]) * 1.0]

    out, notes = fusion.reranked_or_fused(pool, scorer, "query", 5, ["id"])
    rows = sorted(out.collect(), key=lambda r: r.place)
    assert [r.id for r in rows] == [2, 3, 4, 5, 1] and all(r.rerank is None for r in rows) and notes == []
    far = lambda q, t: [-800.0 if "2" in t[0] else 800.0]
    out, _ = fusion.reranked_or_fused(pool, far, "query", 5, ["id"])
    got = {r.id: r.rerank for r in out.collect()}
    assert got[2] == 0.0 and got[3] == 1.0


def test_opened_hits_equal_comparing_all(spark):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(seconds=rng.randrange(900))
    searches = [(i, i % 3, at()) for i in range(40)]
    reads = [(i, i % 3, at(), rng.randrange(5)) for i in range(60)]
    hits = [(i, b, k) for i in range(40) for k, b in enumerate(rng.sample(range(5), 3))]
    want = set()
    for i, s, ts in searches:
        found = [(rt, r, k) for r, rs, rt, b in reads if rs == s and ts <= rt < ts + timedelta(seconds=180) for j, hb, k in hits if j == i and hb == b]
        if found:
            want.add((i, *min(found)[1:]))
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    out = logs.opened_hits(df(searches, "search_id int, session int, search_ts timestamp"), df(reads, "read_id int, session int, read_ts timestamp, book_id int"), df(hits, "search_id int, book_id int, rank int"))
    assert {tuple(r) for r in out.collect()} == want


def test_recent_errors(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, t0 = random.Random(7), datetime(2024, 1, 1)
    schema, rings, batches = "pid long, code string, ts timestamp", {}, []
    clock = 0
    for _ in range(3):
        rows = []
        for _ in range(30):
            clock += 1
            rows.append((rng.randrange(2), f"e{rng.randrange(9)}", t0 + timedelta(seconds=clock)))
        batches.append(rows)
    for p, c, ts in sum(batches, []):
        ring = rings.setdefault(p, {})
        n, first = ring.pop(c, (0, ts, ts))[:2]
        ring[c] = (n + 1, first, ts)
        if len(ring) > 5:
            del ring[next(iter(ring))]
    src = str(tmp_path / "in")
    seen = {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        out = pipelines.recent_errors(stream, "pid", ["code"], "ts", most=5)
        keep = lambda df, _: seen.update({p: [tuple(r[1:]) for r in sorted(df.collect(), key=lambda r: r.place) if r.pid == p] for p in {r.pid for r in df.collect()}})
        out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen == {p: [(i + 1, c, *v) for i, (c, v) in enumerate(reversed(ring.items()))] for p, ring in rings.items()}

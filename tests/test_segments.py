"""Tables in segments, positional postings and phrases, against plain versions."""

import random
import re

import pytest

from lectern.operators import keyword, phrases
from lectern.operators.segments import Conflict, Table
from lectern.streaming import pipelines

WORDS = "the red fox and node.js ran c++ over a hill hills".split()


def rows_of(table, name="rows"):
    return sorted(tuple(r) for r in table.read(name).select("k", "v").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_random_commits_and_merges_keep_the_last_rows(spark, tmp_path):
    rng = random.Random(5)
    table, plain, old = Table(spark, str(tmp_path / "t"), "k"), {}, {}
    for i in range(6):
        changed = {rng.randrange(30): [f"{i}-{n}" for n in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 8))}
        gone = {rng.randrange(30) for _ in range(rng.randint(0, 4))} - set(changed)
        at = table.commit({"rows": frame(spark, [(k, v) for k, vs in changed.items() for v in vs])}, frame(spark, [(k, None) for k in gone]) if gone else None)
        plain = {k: v for k, v in plain.items() if k not in gone} | changed
        old[at.number] = sorted((k, v) for k, vs in plain.items() for v in vs)
        if i % 3 == 2:
            table.merge(fanout=2)
        assert rows_of(table) == old[at.number]
    assert sorted(tuple(r) for r in table.read("rows", table.snapshot(2)).select("k", "v").collect()) == old[2]
    table.merge(everything=True)
    at = table.snapshot()
    assert len(at.segments) == 1 and not at.graves and rows_of(table) == old[max(old)]
    table.vacuum()
    assert rows_of(table) == old[max(old)] and len(table._listed("segments")) == 1 and table.numbers() == [at.number]


def test_a_commit_writes_changed_keys_only(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "k")
    table.commit({"rows": frame(spark, [(k, "old") for k in range(100)])})
    at = table.commit({"rows": frame(spark, [(5, "new")])})
    assert [s.rows for s in at.segments] == [100, 1] and rows_of(table)[4:7] == [(4, "old"), (5, "new"), (6, "old")]


def test_conflicts_batches_revert_and_broken_snapshots(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "k")
    first = table.commit({"rows": frame(spark, [(1, "a"), (2, "b")])}, batch=("s", 0))
    table.commit({"rows": frame(spark, [(1, "c")])}, base=first)
    with pytest.raises(Conflict):
        table.commit({"rows": frame(spark, [(1, "lost")])}, base=first)
    assert rows_of(table) == [(1, "c"), (2, "b")]
    assert table.commit({"rows": frame(spark, [(9, "again")])}, batch=("s", 0)).number == 2 and rows_of(table) == [(1, "c"), (2, "b")]
    (tmp_path / "t" / "snapshots" / "000000000003.json").write_text('{"number": 3, "segm')
    assert rows_of(table) == [(1, "c"), (2, "b")]
    with pytest.raises(Conflict):  # it may be another writer's, at work
        table.commit({"rows": frame(spark, [(3, "d")])})
    table.repair()
    table.revert(1)
    assert rows_of(table) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        table.commit({"rows": frame(spark, [(None, "x")])})
    table.commit(removed=frame(spark, [(1, None), (2, None), (77, None)]))
    assert rows_of(table) == []


def texts(n=60):
    rng = random.Random(8)
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for i in range(n)}


def tokens(text):
    return re.findall(r"[\w+#.\-]+", (text or "").lower())


def starts(text, words, prefix=False):
    t = tokens(text)
    fits = lambda at: all(a == b for a, b in zip(t[at:], words)) if not prefix else all(a == b for a, b in zip(t[at:], words[:-1])) and t[at + len(words) - 1].startswith(words[-1])
    return [at for at in range(len(t) - len(words) + 1) if fits(at)]


def test_phrases(spark):
    docs = texts() | {100: None, 101: "", 102: "The the THE", 103: "hills hill hillside"}
    df = spark.createDataFrame([(i, t, "red fox") for i, t in docs.items()], "id long, body string, note string").repartition(3)
    listed = phrases.postings(df, "id", ["body", "note"]).cache()
    plain = keyword.postings(df, "id", ["body", "note"])
    assert sorted(map(tuple, listed.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    for text in ("red fox", "the the", "the", "and node.js ran", "over a hil*", "hil*", "a", "zzz", "c++ over"):
        p = phrases.Phrase.of(text)
        got = {(r.id, r.col): r.starts for r in phrases.hits(listed, "id", [p]).collect()}
        want = {(i, "body"): s for i, t in docs.items() if (s := starts(t, list(p.words), p.prefix))}
        if text == "red fox":
            want |= {(i, "note"): [0] for i in docs}
        assert got == want, text
    a, b, c = (phrases.Phrase.of(t) for t in ("red fox", "node.js", "hil*"))
    found = phrases.hits(listed.where("col = 'body'"), "id", [a, b, c])
    has = lambda t, p: bool(starts(t, list(p.words), p.prefix))
    got = {r.id for r in phrases.matching(found, "id", all_of=[b], any_of=[a, c], none_of=[phrases.Phrase.of("zzz")]).collect()}
    assert got == {i for i, t in docs.items() if has(t, b) and (has(t, a) or has(t, c))}
    got = {r.id for r in phrases.matching(found, "id", all_of=[b], none_of=[c]).collect()}
    assert got == {i for i, t in docs.items() if has(t, b) and not has(t, c)}
    assert phrases.hits(listed, "id", [phrases.Phrase.of("!?")]).collect() == []


def full(spark, docs):
    df = spark.createDataFrame([(i, i // 2, t) for i, t in docs.items()], "chunk_id long, book_id long, body string")
    n = [len(tokens(t)) for t in docs.values()]
    scores = keyword.bm25(keyword.postings(df, "chunk_id", ["body"]), "chunk_id", ["red", "node.js", "the"], len(n), sum(n) / len(n))
    return {r.chunk_id: round(r.score, 9) for r in scores.collect()}


def units(spark, docs, books):
    return spark.createDataFrame([(i, i // 2, t) for i, t in docs.items() if i // 2 in books], "chunk_id long, book_id long, body string")


def test_incremental_index_equals_a_full_one(spark, tmp_path):
    docs = texts()
    index = phrases.Index(spark, str(tmp_path / "i"))
    stale = {i: "the red the" if i % 5 == 0 else t for i, t in docs.items()} | {200: "red red gone", 201: "the"}
    index.commit(units(spark, stale, {*range(20), 100}))
    index.commit(units(spark, docs, {*range(20, 30)}))
    index.commit(units(spark, docs, {i // 2 for i in range(0, 40, 5)}), spark.createDataFrame([(100,)], "book_id long"))
    score = lambda: {r.chunk_id: round(r.score, 9) for r in index.scores(["red", "node.js", "the"]).collect()}
    assert score() == full(spark, docs)
    index.table.merge(fanout=2)
    assert score() == full(spark, docs) and len(index.table.snapshot().segments) < 3
    n = [len(tokens(t)) for t in docs.values()]
    assert index.totals() == (len(n), sum(n) / len(n))
    got = {r.chunk_id for r in index.search(all_of=[phrases.Phrase.of("red fox")], none_of=[phrases.Phrase.of("hil*")]).collect()}
    assert got == {i for i, t in docs.items() if starts(t, ["red", "fox"]) and not starts(t, ["hil"], True)}


def test_stream_keeps_an_index(spark, tmp_path):
    docs = texts(24)
    source, index = str(tmp_path / "in"), phrases.Index(spark, str(tmp_path / "i"), book="chunk_id")
    schema = "chunk_id long, body string, last_modified long, deleted boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        pipelines.indexed(stream, index, str(tmp_path / "check"), deleted="deleted").awaitTermination()

    put([(i, "old the red", 1, None) for i in range(12)])
    run()
    put([(i, docs[i], 2, False) for i in range(24)] + [(3, "between", 1, False), (50, "red", 1, None), (None, "x", 1, None)])
    put([(50, None, 2, True), (4, "late the red", 0, False)])
    run()
    want = {k: v for k, v in docs.items()}
    df = spark.createDataFrame(list(want.items()), "chunk_id long, body string")
    n = [len(tokens(t)) for t in want.values()]
    scores = keyword.bm25(keyword.postings(df, "chunk_id", ["body"]), "chunk_id", ["red", "the"], len(n), sum(n) / len(n))
    assert {r.chunk_id: round(r.score, 9) for r in index.scores(["red", "the"]).collect()} == {r.chunk_id: round(r.score, 9) for r in scores.collect()}
    assert index.table.snapshot().batches == {"books": 2} and index.table._listed("incoming") == []


def test_annotations_and_notes(spark):
    rows = [(1, 7, "a red fox", None), (2, 7, "nothing", "RED FOX here"), (3, 8, "red", "fox"), (4, 8, None, None)]
    df = spark.createDataFrame(rows, "id long, book_id long, text string, note string")
    ids = lambda query, **more: sorted(r.id for r in phrases.search_rows(df, "id", ["text", "note"], query, **more).collect())
    assert ids("red fox") == [1, 2] and ids("red fox", in_book=7) == [1, 2] and ids("red", in_book=8) == [3]
    assert ids("*", in_book=8) == [3, 4] and ids("...!") == [] and ids("fo*") == [1, 2, 3]
    with pytest.raises(ValueError):
        ids(" * ")
    best = phrases.search_rows(df, "id", ["text", "note"], "fox").orderBy("score").first()
    assert best.id == 3 and best.score < 0

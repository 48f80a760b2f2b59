"""Queries whose cost must grow no faster than their input: what they read, shuffle and hold."""

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lectern.operators import keyword, phrases
from lectern.plans import retrieval

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["body_quota", "reranked", "admit_prefix", "confidence"])
def test_vector_half_alone(spark, monkeypatch, query):
    def built(*_):
        raise AssertionError("the keyword index is not needed")

    monkeypatch.setattr(retrieval, "index_of", built)
    assert retrieval.QUERIES[query](spark, SMALL).count() > 0


@pytest.mark.parametrize("most", [1 << 21, 7, 1])
def test_postings_in_runs(spark, monkeypatch, most):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "the", "Red", "node.js", "é", "\U0001f600x", "日本"])
    rows = [(i, None if i % 7 == 0 else " ".join(word() for _ in range(rng.randrange(9))), " ".join(word() for _ in range(rng.randrange(3)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, body string, note string").coalesce(2)
    monkeypatch.setattr(keyword, "RUN_TOKENS", most)
    want = []
    for i, *texts in rows:
        lists = [regex.findall(keyword.TOKEN, (t or "").lower()) for t in texts]
        for col, terms in zip(("body", "note"), lists):
            want += [(i, col, t, n, sum(map(len, lists)), [k for k, x in enumerate(terms) if x == t]) for t, n in Counter(terms).items()]
    made = phrases.postings(df, "id", ["body", "note"])
    got = [(r.id, r.col, r.term, r.tf, r.len, r.positions) for r in made.collect()]
    assert sorted(got) == sorted(want)
    assert sorted(map(tuple, keyword.postings(df, "id", ["body", "note"]).select("id", "col", "term", "tf", "len").collect())) == sorted(w[:5] for w in want)
    assert "Exchange" not in plan(made)
    if most > 1000:  # one run a task, each column of it by term
        by_task = made.where("col = 'body'").select(F.spark_partition_id().alias("p"), "term").collect()
        for p in {r.p for r in by_task}:
            terms = [r.term.encode() for r in by_task if r.p == p]
            assert terms == sorted(terms)


def test_commits_do_not_shuffle_postings(spark, tmp_path, monkeypatch):
    from lectern.operators import segments

    written = []
    write = segments.Table._write
    monkeypatch.setattr(segments.Table, "_write", lambda self, tables, *a: written.append(plan(tables["postings"])) or write(self, tables, *a))
    index = phrases.Index(spark, f"file://{tmp_path}/ix", "id", "id")
    rows = lambda *ids: spark.createDataFrame([(i, f"the of the {i} of") for i in ids], "id long, body string")
    index.commit(rows(*range(20)))
    index.commit(rows(*range(5)), rows(19).select("id"))
    assert index.table.snapshot().graves and "BroadcastHashJoin" in plan(index.postings())
    monkeypatch.setattr(segments, "GRAVES", 0)
    assert "Broadcast" not in index.postings().hint("merge")._jdf.queryExecution().optimizedPlan().toString().replace("autoBroadcast", "")
    assert index.postings().where("term = 'the'").count() == 19
    index.table.merge(everything=True)
    assert index.postings().where("term = 'the'").count() == 19
    assert len(written) == 3 and "Exchange" not in written[0] + written[1]


def test_phrases_share_one_pass(spark):
    df = spark.createDataFrame([(1, "the of and the"), (2, "is this for the"), (3, "and the end")], "id long, body string")
    found = phrases.hits(phrases.postings(df, "id", ["body"]), "id", [phrases.Phrase.of(t) for t in ("the of", "and the", "is th*", "for the", "the")])
    assert plan(found).count("Exchange hashpartitioning") == 1
    got = sorted((r.id, r.term, r.tf, r.starts) for r in found.collect())
    assert got == [(1, "and the", 1, [2]), (1, "the", 2, [0, 3]), (1, "the of", 1, [0]), (2, "for the", 1, [2]), (2, "is th*", 1, [0]), (2, "the", 1, [3]), (3, "and the", 1, [0]), (3, "the", 1, [1])]


def test_stream_index_reads_in_parallel(spark, tmp_path):
    """The stream's files are as many as the tasks that write them."""
    from lectern.plans import indexing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")  # noqa: F841
    made = []
    keep = indexing.scratch_folder
    indexing.scratch_folder = lambda s, name: made.append(keep(s, name)) or made[-1]
    try:
        rows = indexing.stream_index(spark, f"file://{tmp_path}").collect()
    finally:
        indexing.scratch_folder = keep
    assert rows and len(spark.read.parquet(f"{made[0]}/in").inputFiles()) > 2


def test_arrow_functions_hold_few_rows(spark):
    """Texts become results slice by slice, in Arrow, whatever a batch holds."""
    from pyspark.util import PythonEvalType

    from lectern.operators import etl, spans, stemming

    for f in (etl.embedded, etl.encode_vector, etl.decode_vector, stemming.stems, spans._decode):
        assert f.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    texts = [None if i % 50 == 7 else "" if i % 50 == 8 else "e​" * (i % 5) + f" w{i} running" for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    out = etl.normalised(df, "id", "text").withColumn("map", spans.encode_offset_map("edits")).withColumn("back", spans.decode_offset_map("map"))
    assert "MapInArrow" in plan(out)
    out = out.join(df.select("id", stemming.stems("text", F.lit(None).cast("string")).alias("stems"), etl.decode_vector(etl.encode_vector(etl.embedded("text"))).alias("v")), "id")
    for r in out.collect():
        clean, edits = (None, []) if texts[r.id] is None else etl.normalise(texts[r.id])
        assert (r.text, [tuple(e) for e in r.edits], r.back) == (clean, edits, r.edits)
        assert r.stems == stemming.stem_tokens(texts[r.id] or "") and len(r.v) == etl.DIM


def test_captions_are_not_broadcast(spark):
    """Lines that a few bytes of a table grow into must not be sent whole to every executor."""
    from lectern.plans import indexing

    out = indexing.layout_captions(spark, SMALL)
    assert "Broadcast" not in plan(out) and out.count() > 0


@pytest.mark.parametrize("query", ["outline_chapters", "markup_rules"])
def test_made_texts_are_spread(spark, query):
    from lectern.plans import documents

    assert documents.QUERIES[query](spark, SMALL).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_probe_compares_signals_only(spark):
    """Many books of one work: what a new one is compared with is bounded by what is asked for, and the answer is that of all pairs."""
    from lectern.operators import curation

    rows = [(i, ("The Work" if i % 3 == 2 else f"The Work, {i % 3 + 1}{'st' if i % 3 == 0 else 'nd'} Edition"), ["Ann Writer"] if i % 4 else [], {"isbn": "9780306406157"} if i in (40, 50) else {"x": "y"}) for i in range(60)]
    books = spark.createDataFrame(rows, "id long, title string, authors array<string>, identifiers map<string,string>").withColumn("pubdate", F.lit(None).cast("string"))
    found = curation.add_probe(books.where("id % 10 = 0"), books, 3)
    edition = lambda i: None if i % 3 == 2 else i % 3
    for r in found.collect():
        fits = [i for i in range(60) if i != r.new_id and (edition(i) is None or edition(r.new_id) is None or edition(i) == edition(r.new_id))]
        isbn = [i for i in (40, 50) if r.new_id in (40, 50) and i != r.new_id]
        assert r.ids == sorted({*fits, *isbn})[:3] and r.reason == ("isbn" if isbn else "title")
    assert found.count() == 6
    assert "slice(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_library_moves_no_texts(spark, tmp_path, monkeypatch):
    """Chunks are made and written once, without a shuffle; a new stamp alone writes rows of books only."""
    from lectern.operators import segments
    from lectern.operators.library import Library

    chunk_plans = []
    write = segments.Table._write
    monkeypatch.setattr(segments.Table, "_write", lambda self, tables, *a: chunk_plans.append(plan(tables["chunks"])) or write(self, tables, *a))
    frame = lambda stamps: spark.createDataFrame([(i, f"Title {i}", f"# Part\nThe red fox ran. Dogs are running {i}. " * 4, s) for i, s in enumerate(stamps)], "book_id long, title string, text string, last_modified string")
    library, full = (Library(spark, f"file://{tmp_path}/{x}", 60) for x in "ab")
    library.update(frame("1111"))
    got = library.update(frame("22221"))
    assert all("Exchange" not in p.replace("BroadcastExchange", "") for p in chunk_plans)
    assert {r.book_id: r.action for r in got.plan.collect()} == dict.fromkeys(range(4), "refresh") | {4: "replace"}
    last = got.snapshot.segments[-1]
    held = {n: {r.book_id for r in spark.read.parquet(f"{tmp_path}/a/segments/{last.name}/{n}").collect()} for n in ("books", "chunks", "postings")}
    assert held == {"books": {0, 1, 2, 3, 4}, "chunks": {4}, "postings": {4}}
    full.update(frame("22221"))
    rows = lambda x: [sorted(map(repr, x.read(n).select(*sorted(x.read(n).columns)).collect())) for n in ("books", "chunks", "sections", "postings")]
    want = rows(full)
    assert rows(library) == want and library.table.snapshot().facts == full.table.snapshot().facts
    # The first segment's rows of books are all hidden, its chunks are not.
    at = library.table.snapshot()
    alone = segments.replace(at, number=at.number + 1, segments=at.segments[:1])
    library.table._publish(alone)
    library.table.merge(everything=True)
    assert library.read("books").count() == 0 and library.read("chunks").where("book_id < 4").count() == full.read("chunks").where("book_id < 4").count() > 0
    library.table.revert(at.number)
    library.table.merge(everything=True)
    assert rows(library) == want and not library.table.snapshot().graves


def test_chunks_and_stems_take_one_pass(spark, monkeypatch):
    """A text goes to Python once for its chunks and all stems of them, and only texts with a sign of one are searched for headings."""
    from lectern.operators import matter, stemming, structure

    texts = ["The foxes were running. " * 30, "# Part\nDogs ran (1999).\n" * 20, "Лисицы бежали быстро. " * 30, "a b\nReferences\n" + ("Fox (2001) pp. 1\n" * 5 + "Doı: doı: 3\n") * 6 + "The end. " * 60, "", None]
    df = spark.createDataFrame([(i, t, None if i == 1 else f"Running {i}", "ru" if i == 2 else "en") for i, t in enumerate(texts)], "id long, text string, title string, lang string")
    made = structure.placed_chunks(df, "id", "text", 200, ["title", "lang"], {"body_stem": "body", "title_stem": "title"})
    # As the finding's plan was: stems in a pass of their own, and a look at each line of each chunk.
    assert plan(made).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan(made) and "MapInPandas" not in plan(made)
    join = lambda t, lang: " ".join(stemming.stem(m, lang) for m in regex.findall(r"[\p{L}\p{N}_]+", t or ""))
    rows = made.collect()
    assert {r.id for r in rows} == {0, 1, 2, 3} and {r.matter_kind for r in rows if r.id == 3} == {"body", "back_biblio"}
    for r in rows:
        assert r.body == texts[r.id][r.char_start : r.char_end] and r.body_stem == join(r.body, r.lang) and r.title_stem == join(r.title, r.lang)
        front = r.matter_kind == "front"
        kind = matter.kind(r.body, r.char_start / len(texts[r.id]), front, "")
        assert front or r.matter_kind == kind
        assert matter.may_need_code(r.body, 0.5) or matter.kind(r.body, 0.5, False, "bibliography") == "body"

    def searched(_):
        raise AssertionError("nothing in the text can be a heading")

    monkeypatch.setattr(structure, "_scanned", searched)
    assert structure.front_end(texts[0]) == 0 and structure.chapters(texts[0]) == ("none", [])


def test_stems_are_made_anew_when_too_many(monkeypatch):
    from lectern.operators import stemming

    words = [w for i in range(40) for w in (f"running{'ab'[i % 2] * i}", "Running", "aB", "x1", "É", "Бежали", "日本", "Y", "HOPPING")]
    want = [stemming._stem.__wrapped__(w, "en", stemming.PACKS) for w in words]
    stemming._stems_of.cache_clear()
    monkeypatch.setattr(stemming, "KNOWN", 5)
    assert stemming.stem_tokens(" ".join(words), "en") == want and len(stemming._stems_of("en", stemming.PACKS)) <= 5


def test_language_of_plain_texts(spark):
    from lectern.operators import languages

    texts = ["The fox", "123 ...", "", None, "É", "a" * 70_000 + "Б" * 90_000, "Лис ы", "1 fox 2", "\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", languages.detected("text").alias("lang")).collect()
    assert {r.id: r.lang for r in rows} == {i: None if t is None else languages.language(t) for i, t in enumerate(texts)}

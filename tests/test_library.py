import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import isbn as isbns
from lectern.functions import text as tx
from lectern.functions import titles
from lectern.operators import audits, catalogue, curation, etl, evaluation, fusion, index, keyword, logs, merging, query_lang, spans, stemming, structure, vectors
from lectern.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_isbn(spark):
    rows = spark.createDataFrame([("0-306-40615-2",), ("9780306406157",), ("080442957X",), ("9780306406158",), ("",), (None,)], "s string")
    got = [(r.v, r.t) for r in rows.select(isbns.is_isbn("s").alias("v"), isbns.to_isbn13("s").alias("t")).collect()]
    assert got == [(True, "9780306406157"), (True, "9780306406157"), (True, "9780804429573"), (False, None), (False, None), (False, None)]
    text = "bare 0306406152, ISBN 978-0-306-40615-7 and 1111111111"
    assert one(spark, isbns.extract_isbns(F.lit(text))) == ["9780306406157", "0306406152"]
    assert isbns.isbns_in("Next Book (218 pages) ISBN: 9780306406157 $45.95") == []
    assert isbns.isbns_in("ISBN 9780306406157 $9\n ISBN 080442957X $8") == [] and isbns.isbns_in("ISBN 9780306406157 $9") == ["9780306406157"]
    assert isbns.isbns_of_book("x" * 30_000 + " ISBN 9780306406157 " + "y" * 30_000) == ["9780306406157"]


def test_text_keys(spark):
    assert one(spark, tx.identical_key(F.lit(" The  Book "), F.array(F.lit("B b"), F.lit("a A")))) == "the book\u0001a a\u0002b b"
    names = {"Jane Doe": "Doe, Jane", "Doe, Jane": "Doe, Jane", "Plato": "Plato", "Martin Luther King Jr.": "King, Martin Luther Jr."}
    for name, want in names.items():
        assert one(spark, tx.author_sort(F.lit(name))) == want
    assert one(spark, tx.pub_year(F.lit("0101-01-01T00:00:00"))) is None and one(spark, tx.pub_year(F.lit("1999-05-01"))) == 1999
    assert tx.fold_text("Éclair ёж й") == "Eclair еж й"
    assert one(spark, tx.html_text(F.lit("<p>A &amp; B<br>C</p><script>x()</script>"))) == "A & B\nC"


EDITIONS = {
    "deep things, 3rd edition: revised": 3, "nodejs 2nd ed. 2020": 2, "go 3e": 3, "edition 4 of it": 4, "третье издание книги": 3, "алгоритмы 3-е издание": 3, "алгоритмы, 2-ге вид.": 2, "друге видання": 2, "издание 5-е, доп.": 5,
    "python 3": None, "web 2.0": None, "первый вид 3": None, "c++20": None, "3 вид леса": None, "special edition": None,
}


def test_editions_and_works():
    for title, want in EDITIONS.items():
        assert titles.without_edition(title)[1] == want, title
    assert titles.without_edition("deep things, 3rd edition: revised")[0] == "deep things, " and titles.without_edition("2nd edition of go")[0].strip() == "of go"
    assert titles.without_year("Excel 2019") == ("Excel", 2019) and titles.without_year("1984") == ("1984", None)
    a, b = titles.work_of("Node.js Design Patterns", ["A. Bé"]), titles.work_of("The NodeJS Design Patterns 3rd Edition 2020 [print PDF]", ["a be"])
    assert a.key == b.key == "nodejsdesignpatterns|a be" and (a.edition, b.edition) == (None, 3)
    assert titles.work_of("Deep Work: Volume One", []).subtitle == "volumeone" and titles.work_of("?!", ["x"]) is None and titles.work_of("Excel 2019", []).title_year == 2019


def test_file_titles_and_authors():
    for t in ("215479", "215479-01", "B00ABCDEFG", "x.pdf", "pro-vim-2014", "Cover", "book (3)", "Title (1)", "Title copy", "building.large.models", "Go - PDFDrive.com", "[LeanPub] Go", "1233 2 SQL Kindle img"):
        assert titles.has_file_shape(t), t
    for t in ("Python 3", "Node.js", "Advertising Copy", "[Re]Thinking Design", "Self-Hosting", "Clean Code (Robert C. Martin Series)"):
        assert not titles.has_file_shape(t, ["Robert C. Martin"]), t
    assert titles.has_file_shape("Go Design Patterns (Mario  Castro)", ["mario castro"]) and not titles.has_file_shape("Go (Unknown)", ["Unknown"])
    slugs = {"modular-monoliths": "modular monoliths", "Microsoft Word - My Report.docx": "My Report", "1233 2 PostgreSQL MADE EASY Kindle img": "PostgreSQL MADE EASY", "Self-Hosting": None, "top.dvi": None, "215479-01": None, "A Title": None, "[X] ddd_distilled (2)": "ddd distilled"}
    assert {t: titles.slug_query(t) for t in slugs} == slugs
    assert titles.split_authors("Petre, Marian,Hoek, André van der") == ["Marian Petre", "André van der Hoek"] and titles.split_authors("Ian Miell, Aidan Hobson Sayers") == ["Ian Miell", "Aidan Hobson Sayers"] and titles.split_authors("a, b, c") == ["a, b, c"]
    assert titles.clean_authors(["Graham, Paul;", "paul graham"]) == ["Paul Graham"] and [titles.author_fault(a) for a in ("2007", "A; B", "B, A", "A B")] == ["no-letters", "semicolon", "comma", None]
    assert titles.agree("Red Book", "The Red Book of Things") and not titles.agree("Red Book", "Blue Sky") and titles.agree("Café", "cafe noir") and not titles.agree("Python Basics", "Python Tricks") and titles.agree("The", "x")
    assert [titles.matter_title(t) for t in ("Preface to the 2nd", "О’Reilly", "Table of  Contents", "Prefaces in Kotlin", "Указатель", "References", "INDEX")] == ["front", None, "front", None, "index", "bibliography", "index"]


def test_vectors(spark):
    rng = random.Random(1)
    rows = [(i, i % 5, i % 3 != 0, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, book long, body boolean, vector array<float>")
    query = [0.1, 0.2, 0.3, 0.4]
    score = lambda v: sum(a * b for a, b in zip(v, query))
    want = sorted(rows, key=lambda r: (-round(score(r[3]), 9), r[1], r[0]))
    got = vectors.vector_topk(df.withColumn("vector", F.col("vector")), query, 7, "id", order=("book",)).collect()
    assert [round(r.score, 9) for r in got] == [round(score(r[3]), 9) for r in want[:7]]
    assert vectors.vector_topk(df, query, -3, "id").count() == 0
    best = {r.book: r.id for r in vectors.best_per_book(df.withColumn("score", vectors.dot("vector", query)), "book", "id", F.col("body")).collect()}
    for b in range(5):
        pool = [r for r in rows if r[1] == b and r[2]] or [r for r in rows if r[1] == b]
        assert best[b] == min(pool, key=lambda r: (-round(score(r[3]), 9), r[0]))[0]
    ranked = spark.createDataFrame([(i, i % 3 == 0) for i in range(12)], "rank int, body boolean")
    assert [r.rank for r in vectors.body_quota(ranked, 2, "body", [F.col("rank")]).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_keyword_plan():
    plan = keyword.plan_query("the rare c++ word rare", {"the": 90, "rare": 2, "word": 40}, 100)
    assert [(t.text, t.columns) for t in plan.terms] == [("rare", keyword.STEMMED), ("c", keyword.STEMMED), ("word", keyword.STEMMED), ("c++", None), ("c++.", None)]
    assert plan.dropped == (("the", "too-common"), ("rare", "duplicate"))
    assert [t.text for t in keyword.plan_query("the", {"the": 90}, 100).terms] == ["the"]
    assert [t.text for t in keyword.plan_query("the of", {"the": 90, "of": 80}, 100).terms] == ["of"]
    assert [t.text for t in keyword.plan_query('"the of" it', {"the": 90, "of": 80, "it": 70}, 100).terms] == ["the", "of"]
    gone = keyword.plan_query("c++ rare", {"c": 90}, 100)
    assert [t.text for t in gone.terms] == ["rare"] and ("c++", "too-common") in gone.dropped


def test_stems():
    for w, want in {"caresses": "caress", "flies": "fli", "dies": "die", "hopping": "hop", "hoping": "hope", "relational": "relat", "happiness": "happi", "running": "run", "agreed": "agre", "generate": "generat", "nationally": "nation", "skies": "sky", "dying": "die", "proceed": "proceed", "news": "news"}.items():
        assert stemming.english(w) == want, (w, stemming.english(w))
    for w, want in {"книга": "книг", "книги": "книг", "книгу": "книг", "важная": "важн", "важнее": "важн", "бегать": "бега", "вышедши": "вышедш", "ёлка": "елк", "зимний": "зимн", "радость": "радост"}.items():
        assert stemming.russian(w) == want, (w, stemming.russian(w))
    assert stemming.stem_tokens("Running api_v2 camelCase книги 42") == ["run", "api_v2", "camelcase", "книг", "42"]
    uk = stemming.Pack("uk", "Cyrillic", "іїєґ", lambda w: w[:-2])
    packs = (*stemming.PACKS, uk)
    assert stemming.pack_of("книги", "uk", packs) is uk and stemming.pack_of("мова", None, packs).id == "ru" and stemming.pack_of("їжак", None, packs) is uk and stemming.pack_of("42", None, packs) is None
    both = frozenset({"ru", "uk"})
    assert [len(w.stems) for w in stemming.query_words("мова", both, packs)] == [2] and [len(w.stems) for w in stemming.query_words("мова їжак", both, packs)] == [1, 1]
    assert stemming.stem_version(packs) == "en:1|ru:1|uk:1"


def test_keyword_columns(spark, tmp_path):
    """Every column's tokens count to a unit's length, and an identifier form is found in the text as it is."""
    import math

    docs = spark.createDataFrame([(1, "c++ and node.js", "c and node js", "go book"), (2, "plain words here", "plain word here", "go"), (3, "node.js.", "node js", None)], "id long, body string, body_stem string, book_meta string")
    ix = keyword.stored(docs, "id", ["body_stem", "body", "book_meta"], f"file://{tmp_path}/ix")
    assert (ix.total, round(ix.mean_len, 6)) == (3, round((9 + 7 + 3) / 3, 6))
    got = {r.id: r.score for r in keyword.search(ix, keyword.match_terms("node.js").terms, 10).collect()}
    terms = {"node": {1: 1, 3: 1}, "js": {1: 1, 3: 1}, "node.js": {1: 1}, "node.js.": {3: 1}}
    size, mean, want = {1: 9, 2: 7, 3: 3}, 19 / 3, {}
    for f in terms.values():
        idf = max(math.log((3 - len(f) + 0.5) / (len(f) + 0.5)), 1e-6)
        for d, n in f.items():
            want[d] = want.get(d, 0) - idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[d] / mean))
    assert set(got) == {1, 3} and all(abs(got[d] - want[d]) < 1e-9 for d in got)
    assert [r.id for r in keyword.search(ix, [keyword.Term("go", ("book_meta",))], 10).collect()] == [2, 1] and ix.frequencies(["node", "plain"]) == {"node": 2, "plain": 1}
    passages = spark.createDataFrame([(1, 7, False), (2, 7, True), (3, 8, False)], "id long, book_id long, body boolean")
    best = keyword.best_passages(ix, passages, [keyword.Term("node"), keyword.Term("plain")], 0).orderBy("rank").collect()
    assert [(r.book_id, r.id) for r in best] in ([(8, 3), (7, 2)], [(7, 2)])


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.8)], "id long, rank int, score double")
    b = spark.createDataFrame([(2, 1, -3.0), (3, 2, -2.0)], "id long, rank int, score double")
    got = fusion.hybrid(a, b, ["id"], 10).collect()
    assert [(r.id, r.found_by) for r in got] == [(2, "both"), (1, "vector"), (3, "keyword")] and abs(got[0].fused - (1 / 62 + 1 / 61)) < 1e-12
    assert {r.id for r in fusion.rrf([a, b], ["id"], [1, 0]).collect()} == {1, 2}
    rows = spark.createDataFrame([(1, 10), (2, 15), (3, 10), (4, 1)], "rank int, pairs int")
    assert [r.rank for r in fusion.admitted(rows, "pairs", ["rank"]).collect()] == [1, 2]


def test_rerank(spark):
    rows = [(1, 0.9, "b", None, "body"), (2, 0.8, "c", "zz", "body"), (3, 0.7, "i", None, "strong"), (4, 0.6, "y", None, "weak"), (5, 0.5, "z", None, "body"), (6, 0.4, "q", None, "body")]
    pool = spark.createDataFrame(rows, "id int, fused double, text string, alt_text string, tier string")
    scorer = lambda q, ps: [float(ord(p[0]) - 110 + len(p) - 1) for p in ps]
    got = fusion.reranked(pool, scorer, "q", 10, ["id"], limit=5).orderBy("place").collect()
    assert [r.id for r in got] == [2, 5, 1, 6, 4, 3] and [r.used_alt for r in got] == [True, False, False, False, False, False]
    assert got[0].rerank > got[0].other_rerank and got[3].rerank is None and got[5].rerank is None and 0 < got[0].rerank < 1
    assert [r.id for r in fusion.reranked(pool, scorer, "q", 3, ["id"], limit=5, weak_after_body=False).orderBy("place").collect()] == [2, 5, 4]
    assert [r.id for r in fusion.reranked(pool, None, "q", 10, ["id"]).orderBy("place").collect()] == [1, 2, 5, 6, 3, 4]
    strong = fusion.reranked(pool.where("tier = 'strong'"), scorer, "q", 10, ["id"]).collect()
    assert [r.rerank is not None for r in strong] == [True]


def test_query_language(spark):
    df = spark.createDataFrame([(1, "Red Book", ["sci", "Math"], 5.0, dt.date(2023, 12, 5)), (2, "Blue sky", [], None, dt.date(2024, 1, 20)), (3, "red sea", ["math"], 2.0, None)], "id int, title string, tags array<string>, rating double, added date")
    lang = query_lang.Language(df.schema, {c: c for c in df.columns}, ("title", "tags"), {"reds": "title:red", "loop": 'search:"=loop"', "-hide": "id:3"}, dt.date(2024, 1, 25))
    for q, want in {
        "red": [1, 3], "title:red and tags:math": [1, 3], "title:red tags:sci": [1], "red or sky": [1, 2, 3], "not red": [2], 'title:"=red sea"': [3], 'title:"~^r.*k$"': [1],
        "rating:>=2": [1, 3], 'rating:">2"': [1], "tags:false": [2], "tags:true": [1, 3], "added:2024": [2], "added:>2023": [2], "added:lastmonth": [1], "added:thismonth": [2], "added:>10daysago": [2],
        'search:"=reds" and not (tags:sci)': [3], "": [1, 2, 3], "added:false": [3],
    }.items():
        assert [r.id for r in df.where(lang.parse(q)).orderBy("id").collect()] == want, q
    assert [r.id for r in df.where(query_lang.Scope(lang, "reds").predicate("")).collect()] == [1]
    assert df.where(query_lang.Scope(lang, "reds").excluded()).count() == 1
    for bad in ("(red", "red)", "nofield:x", 'search:"=loop"', 'search:"=none"', 'title:"~("', "and"):
        with pytest.raises(query_lang.QueryError):
            lang.parse(bad)


def test_catalogue(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id int, tags array<string>")
    assert [(r.value, r.n) for r in catalogue.facets(df, "tags", limit=5).collect()] == [("a", 2), ("b", 1)]
    c = catalogue.cursor(20, {"q": "x"})
    assert catalogue.read_cursor(c, {"q": "x"}) == 20
    for bad in (c[:-3], "", c):
        with pytest.raises(ValueError):
            catalogue.read_cursor(bad, {"q": "y"})
    assert catalogue.limit_of(0, 10, 50) == 10 and catalogue.limit_of(99, 10, 50) == 50
    bundles = spark.createDataFrame([("a", "x", "saved_search"), ("v", "y", "virtual_library")], "name string, expression string, kind string")
    assert catalogue.save_bundle(bundles, "create", "n", "z").count() == 3 and catalogue.save_bundle(bundles, "delete", "a").count() == 1
    for action, name in (("create", "a"), ("update", "q"), ("update", "v")):
        with pytest.raises(ValueError):
            catalogue.save_bundle(bundles, action, name, "z")


BOOK = "id long, title string, authors array<string>, pubdate string, identifiers map<string,string>, formats array<string>, languages array<string>, tags array<string>, publisher string, comments string, series string, series_index double, author_sort string"


def books(spark):
    def row(i, title, date="2001-01-01", isbn=None, formats=("epub",), lang=("eng",), series=None, n=None):
        return (i, title, ["Jane Doe"], date, {"isbn": isbn} if isbn else {}, list(formats), list(lang), ["t"], "P", None, series, n, "Doe, Jane")

    return spark.createDataFrame([row(1, "Deep Work"), row(2, " deep  WORK", isbn="9780306406157"), row(3, "Deep Work, 2nd Edition"), row(4, "The Deep Work: A Story", "2002-01-01", "0804429573", ("epub", "pdf"), ("rus",)), row(5, "Other", "2010-01-01", series="S", n=1.0), row(6, "scan_0001.pdf", "0101-01-01", "123", series="S", n=4.0), row(7, "Third", series="S", n=4.0), row(8, "Half", series="S", n=2.5)], BOOK)


def test_duplicates_and_quality(spark):
    b = books(spark)
    grouped = lambda m: sorted(sorted(r.ids) for r in m.groupBy("group").agg(F.collect_list("id").alias("ids")).collect())
    assert grouped(curation.identical_members(b)) == [[1, 2]]
    # "A Story" goes first, as it has most signals; the later edition fits it and all others.
    assert grouped(curation.similar_members(b)) == [[1, 2, 3, 4]]
    volumes = b.where("id in (1, 2)").withColumn("title", F.concat(F.lit("Deep Work: Volume "), F.col("id").cast("string")))
    assert grouped(curation.similar_members(volumes)) == [] and grouped(curation.similar_members(volumes.withColumn("title", F.lit("Deep Work (print PDF)")))) == [[1, 2]]
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 4), ("c", 1), ("c", 3), ("d", 1), ("d", 5)], "group string, id long")
    scored = {r.group: (r.work_match, round(r.safety, 3)) for r in curation.scored_groups(members, b).collect()}
    assert scored == {"a": ("same", 0.8), "b": ("same", 0.0), "c": ("edition?", 0.3), "d": ("different", 0.3)}
    assert {r.group: r.keep for r in curation.keepers(members, b).collect()} == {"a": 2, "b": 4, "c": 1, "d": 5}
    many = b.where("id = 1").withColumn("tags", F.array(*(F.lit(f"t{i}") for i in range(9)))).unionByName(b.where("id = 2"))
    assert curation.keepers(members.where("group = 'a'"), many).first().keep == 2
    issues = {(r.id, r.check) for r in curation.row_issues(b).collect()}
    assert {(6, "title"), (6, "isbn"), (6, "pubdate"), (4, "isbn")} == issues
    gaps = curation.series_gaps(b).collect()
    assert [(r.series, r.anchor, [tuple(m) for m in r.missing], r.n_missing, r.repeated) for r in gaps] == [("S", 5, [(2, 3)], 2, [4])]
    wide = spark.createDataFrame([(1, "S", 1.0), (2, "S", 3e9), (3, "S", None)], "id long, series string, series_index double")
    assert curation.series_gaps(wide).first().n_missing == 2_999_999_998
    probe = curation.add_probe(b.where("id = 2").withColumn("id", F.lit(99).cast("long")), b).first()
    assert (probe.ids, probe.reason) == ([1, 2, 3, 4], "isbn")
    raw = b.where("id = 1").withColumn("id", F.lit(98).cast("long")).withColumn("title", F.lit("deep-work-2nd-edition")).withColumn("authors", F.array().cast("array<string>"))
    assert curation.add_probe(raw, b).first().ids == [1, 2, 3, 4]
    assert [r.id for r in curation.skipped_match(raw.withColumn("title", F.lit("OTHER!")), b).collect()] == [5]


def test_merging(spark):
    tags = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, merging.merged_tags(tags("A", "b"), tags("a", "C"), tags("B"))) == ["A", "C"]
    ids = merging.merged_identifiers(F.create_map(F.lit("ISBN"), F.lit("1"), F.lit("x"), F.lit("2")), F.create_map(F.lit("isbn"), F.lit(None).cast("string"), F.lit("Y"), F.lit("3")))
    assert one(spark, ids) == {"x": "2", "y": "3"}
    rows = books(spark).where("id in (1, 2, 4)").withColumn("g", F.lit(1)).withColumn("place", F.when(F.col("id") == 4, 0).otherwise(F.col("id"))).withColumn("rating", F.lit(0.0))
    merged = merging.merge_books(rows, "g", "place").first()
    assert merged.title == "The Deep Work: A Story" and merged.tags == ["t"] and merged.identifiers == {"isbn": "0804429573"}
    after = books(spark).withColumn("publisher", F.when(F.col("id") == 1, "Q").otherwise(F.col("publisher")))
    assert [(r.id, r.before, r.after) for r in merging.changes(books(spark), after, "id", ["publisher", "tags"]).where("changed").collect()] == [(1, "P", "Q")]
    out = {r.id: r.outcome for r in merging.landed(after, books(spark), books(spark), "id", ["publisher"]).collect()}
    assert out[1] == "unchanged" and out[2] == "landed"
    plan = merging.format_plan(rows, "g", "place").collect()
    assert sorted((r.format, r.id, r.action) for r in plan) == [("epub", 1, "dropped"), ("epub", 2, "dropped")]
    hits = spark.createDataFrame([(1, 0, 0, 0.6, "Wrong Thing", "A"), (1, 0, 1, 0.9, "Deep Work Explained", "B"), (1, 1, 0, 0.99, "Late", "C"), (5, 0, 0, 0.9, "Unrelated", "D"), (6, 0, 0, 0.9, "A Real Title", "E")], "id long, provider_order int, place int, confidence double, title string, who string")
    hits = hits.withColumns({"authors": F.array("who"), "publisher": F.lit("Pub"), "pubdate": F.lit("1999-01-01"), "series": F.lit("Ser"), "isbn": F.lit("0306406152")})
    got = {r.id: r for r in merging.proposals(books(spark), hits).collect()}
    assert (got[1].confidence, got[1].title, got[1].isbn) == (0.9, None, "9780306406157") and (got[5].confidence, got[5].mismatch) == (0.3, True)
    assert (got[6].confidence, got[6].title, got[6].pubdate, got[6].series) == (0.9, "A Real Title", "1999-01-01", None)
    assert one(spark, merging.resolved_tags(tags("sci", "New"), tags("SCI"), tags("Sci", "x"))) == ["SCI", "New"]
    notes = one(spark, merging.replacement_notes(tags("A", "b", "c"), tags("a", "d")))
    assert (notes.n_dropped, notes.n_added, notes.dropped, notes.recased) == (2, 1, ["b", "c"], ["A"])


def test_merge_of_a_large_group(spark):
    books = spark.range(1500).selectExpr(
        "'w' AS g", "id AS place", "'T' AS title", "'P' AS publisher", "'2000-01-01' AS pubdate", "'S' AS series", "1d AS series_index", "'c' AS comments", "array('t') AS tags",
        "if(id = 0, map('own', '0'), if(id = 1 or id = 1499, map('many', string(id), 'last', string(id)), map(concat('x', id), string(id)))) AS identifiers",
        "array('Unknown') AS authors", "0d AS rating",
    )
    merged = merging.merge_books(books, "g", "place").first()
    assert merged.identifiers == {"many": "1499", "last": "1499", "own": "0"} | {f"x{i}": str(i) for i in range(2, 1499)} and merged.tags == ["t"] and merged.comments == "c"


def test_etl():
    raw = "A b​ co-\nop ﬁne\r\nx²"
    clean, edits = etl.normalise(raw)
    assert clean == "A b coop fine\nx²"
    for at, ch in enumerate(clean):
        if ch in "Ab opnx²":
            assert raw[etl.to_raw(at, edits)] in (ch, " ", "ﬁ", "c", "-"), (at, ch)
    text = "First sentence here. " * 200 + "\n\n" + "word " * 300
    parts = list(etl.chunks(text, 300))
    assert all(0 < e - s <= 300 for s, e in parts) and all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    assert "".join(text[s:e] for s, e in parts).split() == text.split()
    assert all(n <= 40 for n in (len(text[s:e].split()) for s, e in etl.chunks(text, 40, lambda t: len(t.split()))))
    assert etl.language("Это было давно, и ещё было тихо. Рыба плыла.") == "ru" and etl.language("Їжак їхав у ліс, і ґава є.") == "uk" and etl.language("the cat and the dog of it") == "en" and etl.language("12 34") is None
    body = "x. " * 400 + "Here is the rare needle in it. " + "y. " * 400
    assert "needle" in etl.snippet(body, {"needle": 3.0}, 200) and len(etl.snippet(body, {"needle": 3.0}, 200)) <= 201
    v = etl.hash_embed("a b a")
    assert abs(float((v * v).sum()) - 1) < 1e-6 and etl.hash_embed("")[0] == 1


def test_token_budgets_have_no_cap():
    text = "w" * 5000 + " " + "ab " * 50
    spans_ = list(etl.chunks(text, 10, lambda t: len(t.split())))
    assert spans_[0][1] > 5000 and all(len(text[a:b].split()) <= 10 for a, b in spans_)


def test_markup():
    cases = {
        "a **bold** and *it* b": "a bold and it b", "2 * 3 and a*b*c": "2 * 3 and a*b*c", "x \\(y\\) `c * d` \\*": "x (y) c * d *", "\\# no heading": "\\# no heading", "```\n**x**  \n\n\n\n```": "```\n**x**  \n\n\n\n```",
        "np    .    array    (    x": "np.array(x", "one    two    three    four": "one    two    three    four", "end  \n\n\n\nnext": "end\n\nnext", "# \ntext": "# \ntext", "**open": "**open",
    }
    for raw, want in cases.items():
        clean, edits = etl.without_markup(raw)
        assert clean == want, (raw, clean)
        assert len(clean) - len(raw) == sum((d - c) - (b - a) for a, b, c, d in edits)


def test_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id long, text string")
    assert {r.id: r.text for r in etl.normalised(df, "id", "text").collect()} == {1: None, 2: "", 3: "a b"}


def test_spans_and_maps(spark):
    s = spark.createDataFrame([(1, 0, 10, "front", 1, "A"), (1, 10, 30, "body", 1, "B"), (1, 12, 20, "body", 2, "C")], "book long, char_start int, char_end int, kind string, level int, title string")
    p = spark.createDataFrame([(1, 10), (1, 15), (1, 40)], "book long, at int")
    assert [tuple(r) for r in spans.section_paths(p, s, "book", "at", ["at"]).orderBy("at").collect()] == [(10, ["B"]), (15, ["B", "C"]), (40, [])]
    h = s.withColumn("total", F.lit(50)).drop("char_end", "kind")
    assert sorted((r.title, r.char_end) for r in spans.section_ends(h, "book", "total").collect()) == [("A", 10), ("B", 50), ("C", 50)]
    edits = [(2, 4, 2, 3), (10, 10, 9, 12)]
    df = spark.createDataFrame([(edits,), ([],)], "edits array<struct<in_start:int,in_end:int,out_start:int,out_end:int>>").withColumn("map", spans.encode_offset_map())
    rows = df.withColumn("back", spans.decode_offset_map()).collect()
    assert rows[0].map == "m1:2,2,1,6,0,3" and all(r.back == r.edits for r in rows)


def test_structure(spark):
    text = "Title\n\nChapter 1\nOne\n" + "a " * 900 + "\nII: Two\n" + "b " * 900 + "\n第三章 三\n" + "c " * 900
    source, found = structure.chapters(text)
    assert source == "numeric" and [(n, t) for n, t, _ in found] == [(1, "Chapter 1 One"), (2, "II: Two"), (3, "第三章 三")]
    assert structure.roman_to_int("iiii") is None and structure.roman_to_int("XIV") == 14 and structure.cjk_to_int("二十三") == 23 and structure.cjk_to_int("１２") == 12
    lines = {"Chapter 6 explores what we have seen": None, "Глава 5 рассматривает": None, "Глава 5. Сети": 5, "Chapter 7: X": 7, "Часть 2 Сети": 2, "第１章": 1, "## 第一讲": 1, "Chapter 2025. Years": None, "ch. 4": 4}
    assert {x: structure.chapter_number(x) for x in lines} == lines
    # A contents line has a small body, a running header none of its own.
    book = "Chapter 1: Go .... 5\nChapter 2: On .... 9\n\nChapter 1: Go\n" + "a " * 400 + "\nChapter 1\n" + "b " * 2000 + "\nChapter 2: On\n" + "c " * 900
    assert [(n, t) for n, t, _ in structure.numbered_chapters(book)] == [(1, "Chapter 1: Go"), (2, "Chapter 2: On")]
    assert structure.numbered_chapters(book)[0][2] == book.index("Chapter 1: Go\n")
    assert [t for _, t, _ in structure.structural_chapters("# A\n```\n# no\n```\nB\n===\ntext")] == ["A", "B"]
    assert structure.clean_heading("**[ 1 ]**") == "1" and [structure.anchor_number(t) for t in ("Part II: X", "1. Go", "1.1 Go", "Intro", "1")] == [2, 1, None, None, 1]
    front = "# Cover\nx\n# Preface\n" + "p " * 300 + "\n# Real Start\n" + "t " * 20_000
    assert structure.front_end(front) == front.index("# Real")
    index_body = "\n".join(f"term {i}, {i}" for i in range(12))
    assert structure.matter_kind(index_body, 0.95, False) == "back_index" and structure.matter_kind(index_body, 0.5, False) == "body" and structure.matter_kind("x", 0.5, True) == "front"
    assert structure.matter_kind("All rights reserved.", 0.05, False) == "back_other" and structure.matter_kind("References\n" + "A (1999)\n" * 5, 0.5, False) == "back_biblio"
    contents = "Contents\nFirst thing\nSecond thing\nThird thing"
    assert structure.has_contents(contents) and structure.is_strong_matter("front", contents) and not structure.has_contents("Only\nSome lines.")
    prose = "\n".join("This is a long line of prose that goes on for more than sixty characters, see." for _ in range(4))
    assert structure.has_prose(prose) and structure.has_sentences("One two three four five six. And here are some more words now.") and not structure.is_strong_matter("front", prose)
    df = spark.createDataFrame([(1, text), (2, None)], "book_id long, text string")
    assert structure.chapter_table(df, "book_id", "text").count() == 3
    assert [r.matter_kind for r in structure.placed_chunks(spark.createDataFrame([(1, front)], "book_id long, text string"), "book_id", "text").orderBy("seq").collect()][:2] == ["front", "body"]


def test_book_files():
    from lectern.operators import outlines
    from lectern.sources import books as files

    xml = '<pdf2xml><outline><item page="1">Cover</item><item page="2">Part I</item><outline><item page="3">A &amp; B</item><item page="0">No page</item></outline><outline/><item page="9">End'
    assert files.outline(xml) == [("Cover", 1, 1), ("Part I", 2, 1), ("A & B", 3, 2), ("No page", None, 2)] and files.outline("junk <item>x</item>") == []
    assert files.package_path('<c><rootfile full-path="OPS/p.opf"/></c>') == "OPS/p.opf" and files.package_path("") is None
    opf = '<manifest><item id="a" href="t/one%20.html"/><item id="n" href="nav.xhtml" properties="nav"/><item id="x" href="../toc.ncx"/></manifest><spine toc="x"><itemref idref="a"/><itemref idref="gone"/></spine>'
    assert files.package(opf, "OPS/p.opf") == {"spine": ["OPS/t/one .html"], "nav": "OPS/nav.xhtml", "ncx": "toc.ncx"}
    nav = '<nav epub:type="landmarks"><ol><li><a href="z.html">Z</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="a.html">One <b>x</b></a><ol><li><a href="a.html#s">Sub</a></li></ol></li><li><a href="http://e.org">Out</a></li></ol></nav>'
    assert files.nav_entries(nav, "OPS/nav.xhtml") == [("One x", 1, "OPS/a.html", ""), ("Sub", 2, "OPS/a.html", "s")]
    ncx = '<navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.html"/><navPoint><navLabel><text>Sub</text></navLabel><content src="a.html#s"/></navPoint></navPoint>'
    assert files.ncx_entries(ncx, "toc.ncx") == [("One", 1, "a.html", ""), ("Sub", 2, "a.html", "s")]
    assert files.page_words('<page width="10" height="20.5"><word xMin="1" yMin="2" xMax="3" yMax="4">a&amp;b</word></page><page width="1" height="1"></page>') == (10.0, 20.5, [(1.0, 2.0, 3.0, 4.0, "a&b")])
    docs = [(f"d{i}.html", f"<html><head><title>T</title></head><body><script>x</script><h1>Chapter {i}</h1><p>Opening words number {i} of this very document here.</p></body></html>") for i in range(4)]
    text = "Contents\nChapter 0\nChapter 1\n\n" + "".join(f"# Chapter {i}\n\nOpening *words* number {i} of this very document here.\n\n## Part two of {i}\nmore\n\n" for i in range(4))
    found = outlines.anchors(text, docs)
    assert [p for p, _ in found] == [d for d, _ in docs] and all(text[at:].startswith(f"# Chapter {i}") for i, (_, at) in enumerate(found))
    entries = [("Title Page", 1, "gone.html", "")] + [(f"Chapter {i}", 1, f"d{i}.html", "") for i in range(4)] + [("Part two of 3", 1, "d3.html", "p")]
    chapters = outlines.contents_chapters(text, entries, found)
    assert [t for t, _ in chapters] == ["Chapter 0", "Chapter 1", "Chapter 2", "Chapter 3", "Part two of 3"] and outlines.contents_chapters(text, entries, found[:1]) is None
    dense = [(f"Section {i}", 1, 1) for i in range(1, 9)]
    assert outlines.outline_chapters("a\fb\fc", dense) is None and outlines.outline_chapters("no pages", dense) is None


def test_captions_and_markers():
    page = "Text.\n\nFigure 1.2: A plot of\nthings.\nNext line\n\nРис. 3. Схема сети\n\nand this long line of prose runs on, as shown in\nFigure 9. It goes on.\n\nFigure 4\n\nрис. 5 видно"
    assert [(x, t) for x, t, _ in structure.captions(page)] == [("1.2", "A plot of things."), ("3", "Схема сети"), ("4", "")]
    assert structure.captions("Figure 1\n\nFigure 2\n\nFigure 3\n\nFigure 4\n") == [] and structure.captions("Figure 2\n\nFigure 2. Real\n")[0][:2] == ("2", "Real")
    assert structure.captions("Figure 1. " + "x" * 250 + " of\n" + "y" * 200)[0][1].endswith("…") and structure.marked_cut("a plot of") == "a plot of…"
    assert structure.joined_line("со-", "стояние") == "состояние" and structure.joined_line("well-", "known") == "well-known"
    text, places = structure.with_markers("ab\ncd", [(2, "Two", 3), (1, "", 0)])
    assert text == "[Figure 1]\nab\n[Figure 2: Two]\ncd" and all(text[at:].startswith(f"[Figure {n}") for n, at in places)


def test_audits(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i", "a b c d e f g h x"), (2, "short", "short")], "id int, text string, source string")
    assert [(r.id, r.shared) for r in audits.overlap(df, df.select(F.col("id").alias("sid"), "source"), "id", "text", "sid", "source").collect()] == [(1, 1)]
    q = spark.createDataFrame([(1, 'He said "one two three" and “four five”.\n> block one\n> two'), (2, '"' + "w " * 30 + '"')], "id int, text string")
    assert [(r.longest, r.total, r.ok) for r in audits.quote_budget(q, "id", "text").orderBy("id").collect()] == [(3, 8, True), (30, 30, False)]
    cursor = __import__("base64").urlsafe_b64encode(b'{"offset":3,"id":4,"format":"epub"}').decode().rstrip("=")
    leak = spark.createDataFrame([(f"see {cursor}",), ("plain long_identifier_text",), ("{{ CURSOR }}",)], "t string")
    assert [r.x for r in leak.select(audits.cursor_leak("t").alias("x")).collect()] == [True, False, True]


def test_audit_rules(spark):
    rows = spark.createDataFrame([(1, "ISBN 1, by me; buy it"), (2, "ISBN 1, by me"), (3, None)], "id int, t string")
    assert [r.x for r in rows.orderBy("id").select(audits.attribution("t").alias("x")).collect()] == [True, False, False]
    sizes = spark.createDataFrame([(1, 100, 0), (2, 100, 5), (3, 100, 6)], "id int, a int, b int")
    assert [(r.id, r.ok) for r in audits.compression(sizes, "id", "a", "b").orderBy("id").collect()] == [(1, False), (2, True), (3, False)]
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, f"# {text}\n```\n{text}\n```\nplain")], "id int, t string")
    src = spark.createDataFrame([(7, text)], "sid int, s string")
    assert audits.overlap(df, src, "id", "t", "sid", "s").first().shared == 3 and audits.overlap(df, src, "id", "t", "sid", "s", markdown=True).count() == 0
    assert audits.overlap(df, src, "id", "t", "sid", "s", allow=("a b c d e f g h",)).first().shared == 2


def test_evaluation_rules(spark):
    e = spark.createDataFrame([(i % 2, float(i)) for i in range(11)], "g int, v double")
    assert {r.g: r.cuts for r in evaluation.quartile_cuts(e, "v", "g").collect()} == {0: [2.0, 6.0, 8.0], 1: [3.0, 5.0, 7.0]}
    assert e.agg(evaluation.low_median("v").alias("m")).first().m == 5.0 and e.where("v < 10").agg(evaluation.low_median("v").alias("m")).first().m == 4.0
    f = evaluation.folds(e.withColumn("k", F.col("v").cast("int")), "k", "g", 3).groupBy("g", "fold").count().collect()
    assert sorted(r["count"] for r in f) == [1, 2, 2, 2, 2, 2]
    hits = spark.createDataFrame([(1, 10, 5, 0, 100), (1, 11, 5, 40, 60), (1, 12, 5, 7, 7)], "qid int, hit_id int, book_id int, char_start int, char_end int")
    judged = spark.createDataFrame([(1, 1, 5, "2024", 0, 90), (1, 2, 5, "2025", 45, 60), (1, 3, 5, "2025", 7, 7), (1, 4, 5, "2025", 200, 300)], "qid int, judgment_id int, book_id int, date string, char_start int, char_end int")
    assert sorted((r.hit_id, r.judgment_id) for r in evaluation.judgments_to_hits(judged, hits).collect()) == [(10, 1), (11, 2), (12, 3)]
    lists = lambda *rows: spark.createDataFrame(rows, "qid int, item string, rank int")
    allowed = spark.createDataFrame([(2, ["y"], "better"), (3, ["z"], "none left"), (4, ["q"], " ")], "qid int, items array<string>, reason string")
    changes = evaluation.list_changes(lists((1, "b", 1), (2, "y", 1), (3, "s", 1), (4, "q", 1)), lists((1, "a", 1), (2, "x", 1), (3, "s", 1), (4, "p", 1)), allowed, ["qid"])
    assert {r.qid: r.change for r in changes.collect()} == {1: "broken", 2: "allowed", 3: "stale", 4: "broken"}
    sweep = evaluation.rrf_sweep([lists((1, "a", 1), (1, "b", 2)), lists((1, "b", 1))], spark.createDataFrame([(1, "a")], "qid int, item string"), [(1.0, 0.0), (1.0, 1.0)])
    assert {r.weights: r.hit1 for r in sweep.collect()} == {"1,0": 1.0, "1,1": 0.0}
    means = spark.createDataFrame([("a", "x", 0.96), ("a", "y", 0.95), ("b", "x", 0.9)], "category string, mode string, m double")
    assert {r.category: r.saturated for r in evaluation.saturated(means, "m").collect()} == {"a": True, "b": False}


def test_catalogue_rules(spark):
    c = catalogue.content_cursor(5, 9, "epub")
    assert catalogue.read_content_cursor(c, 9) == (5, 9, "epub")
    for bad in (c[:-4], "x"):
        with pytest.raises(ValueError):
            catalogue.read_content_cursor(bad)
    with pytest.raises(ValueError):
        catalogue.read_content_cursor(c, 8)
    assert catalogue.category_of("Author", ["Authors", "Tags"]) == "Authors" and catalogue.category_of("x", ["Tags"]) is None
    assert [catalogue.has_column_filter(q) for q in ("title:x", "{a b}: x", "std::vector", '"title:x"', "plain")] == [True, True, False, False, False]
    df = spark.createDataFrame([(1, '["A","B"]'), (2, "Solo"), (3, None), (4, "[torn")], "id long, a string")
    assert [r.x for r in df.orderBy("id").select(catalogue.decoded_authors("a").alias("x")).collect()] == [["A", "B"], ["Solo"], [], ["[torn"]]
    rows, total, capped = catalogue.selection(df, "id", [3, 1, 3, 9], most=1)
    assert ([r.id for r in rows.collect()], total, capped) == ([3], 2, True)
    assert [r.f for r in spark.createDataFrame([(["PDF", "md"],), (["xyz"],)], "f array<string>").select(catalogue.preferred_format("f").alias("f")).collect()] == ["md", None]


def test_evaluation(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "z", 1)], "qid string, item string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "x"), ("r", "y")], "qid string, item string")
    m = {r.qid: r for r in evaluation.query_metrics(hits, rel).collect()}
    assert (m["q"].hit1, m["q"].recall, m["q"].rr) == (0.0, 0.5, 0.5) and m["r"].ndcg == 0.0
    import math

    assert abs(m["q"].ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9
    s = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, good boolean")
    assert evaluation.auc(s, "s", "good").first().auc == 0.875 and evaluation.auc(s.where("good"), "s", "good").first().auc is None
    g = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0)], "a int, b int")
    assert abs(evaluation.kappa(g, "a", "b").first().kappa - 0.5) < 1e-9
    assert evaluation.permutation_p([1.0] * 5) == 2 / 32 and evaluation.sign_test(5, 0) == 2 / 32
    lo, hi = evaluation.bootstrap_ci([0.0, 1.0] * 20)
    assert 0.2 < lo < 0.5 < hi < 0.8


def test_logs_and_index(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    calls = spark.createDataFrame([(1, "s", t(0), "search"), (2, "s", t(180), "read"), (3, "s", t(179), "read"), (4, "u", t(5), "read"), (5, "s", t(100), "search")], "id long, pid string, ts timestamp, tool string")
    got = {r.search_id: r.read_id for r in logs.pairs(calls, "pid", "ts", "tool", "search", "read", "id").collect()}
    assert got == {1: 3, 5: 3}
    b = spark.createDataFrame([(1, "T", "Some text. " * 200, "m1"), (2, "U", "Other words here.", "m1")], "book_id long, title string, text string, last_modified string")
    built = index.build(b, f"file://{tmp_path}/ix")
    assert built["chunks"].count() > 2 and built["books"].count() == 2
    index.check_version(spark, f"file://{tmp_path}/ix")
    changed = b.withColumn("text", F.when(F.col("book_id") == 2, "New words.").otherwise(F.col("text"))).withColumn("last_modified", F.lit("m2"))
    assert {r.book_id: r.action for r in index.plan(changed, built["books"]).collect()} == {1: "refresh", 2: "replace"}
    assert {r.action for r in index.plan(b, built["books"]).collect()} == {"skip"}
    assert [r.book_id for r in index.orphans(built["books"], b.where("book_id = 1")).collect()] == [2]
    assert all(r.same for r in index.unchanged(built["chunks"], b).collect())
    holes = built["chunks"].where("seq <> 1")
    assert {r.book_id: r.same for r in index.unchanged(holes, b).collect()} == {1: False, 2: True}
    assert not any(r.same for r in index.unchanged(built["chunks"], b.withColumn("text", F.concat("text", F.lit(" tail")))).collect())
    assert index.stale_stems(built["books"]).count() == 0 and index.stale_stems(built["books"].withColumn("stem_version", F.lit(None).cast("string"))).count() == 2
    assert {r.col for r in built["postings"].select("col").distinct().collect()} == {"body", "body_stem", "book_meta"} and "vectors" not in built
    opened = logs.opened_hits(
        spark.createDataFrame([(1, "s", t(0))], "search_id long, session string, search_ts timestamp"),
        spark.createDataFrame([(5, "s", t(10), 77), (6, "s", t(20), 8), (7, "s", t(30), 9)], "read_id long, session string, read_ts timestamp, book_id long"),
        spark.createDataFrame([(1, 9, 1), (1, 8, 2)], "search_id long, book_id long, rank int"),
    )
    assert [tuple(r) for r in opened.collect()] == [(1, 6, 2)]
    with pytest.raises(ValueError):
        index.orphans(built["books"], b.limit(0))


def test_sources(spark):
    lines = spark.createDataFrame([("f\ti\tone\ttwo",), ("bad\tline",)], "value string")
    assert [tuple(r) for r in readers.notes(lines).collect()] == [("f", "i", "one\ttwo")]
    listing = spark.createDataFrame(list(enumerate(["Name: a", "Search string: x:1", "Name: b", "Name: c", "Search string: y"])), "n int, value string")
    assert sorted(tuple(r) for r in readers.saved_searches(listing, "n").collect()) == [("a", "x:1"), ("c", "y")]
    noise = spark.createDataFrame([('log line\n[{"book_id": 4, "annotation": {"type": "highlight", "highlighted_text": "hi"}}, {"book_id": 5, "text": "flat"}]',)], "value string")
    assert [(r.book_id, r.text) for r in readers.annotations(noise).collect()] == [(4, "hi"), (5, "flat")]
    more = spark.createDataFrame([('note [sic] {"annotations": [{"book_id": 6, "text": "x"}]} [{"book_id": 7}]',), ("none [",), (None,)], "value string")
    assert [r.book_id for r in readers.annotations(more).collect()] == [6]


def test_modes_progress_and_gates(spark, tmp_path):
    assert fusion.effective_mode("hybrid", 0, "long query") == ("keyword", [fusion.NO_VECTORS]) and fusion.effective_mode("hybrid", 3, "ab") == ("hybrid", [fusion.SHORT_QUERY])
    with pytest.raises(ValueError):
        fusion.effective_mode("vector", 0, "x")
    pool = spark.createDataFrame([(1, 0.9, "a", None, "weak"), (2, 0.5, "b", None, "body")], "id int, fused double, text string, alt_text string, tier string")

    def broken(q, ps):
        raise RuntimeError("busy")

    rows, notes = fusion.reranked_or_fused(pool, broken, "q", 5, ["id"])
    assert [r.id for r in rows.orderBy("place").collect()] == [2, 1] and notes == [f"{fusion.NO_RERANK} (busy)"]
    assert [r.id for r in pool.orderBy(*fusion.body_first("tier", F.col("fused").desc())).collect()] == [2, 1]
    books_ = spark.createDataFrame([(1,), (2,), (3,)], "book_id long")
    folder = f"file://{tmp_path}/done"
    assert index.remaining(books_, folder).count() == 3
    index.record_done(books_.where("book_id = 2"), folder)
    index.record_done(books_.where("book_id = 3"), folder)
    assert [r.book_id for r in index.remaining(books_, folder).collect()] == [1]
    have = spark.createDataFrame([(1, 5), (2, 0)], "book_id long, embedded_chunks int")
    assert sorted(r.book_id for r in index.guarded(have, books_).collect()) == [2, 3]
    assert etl.edits_of_insertions([(2, 3), (5, 1)]) == [(2, 2, 2, 5), (5, 5, 8, 9)]
    report = spark.createDataFrame([("hybrid", False, "hit1", 0.8), ("vector", False, "hit1", 0.7)], "mode string, reranked boolean, metric string, value double")
    assert {r.check: r.ok for r in evaluation.tier_gate(report, {"hit1": 0.75}).collect()} == {"rerank off": True, "hybrid hit1": True, "vector hit1": False}
    judge = lambda *rows: spark.createDataFrame(rows, "k int, grade int")
    faults = evaluation.violations(judge((1, 2), (2, 7), (3, 1)), judge((1, 0), (2, 1), (2, 1)), "k")
    assert sorted(tuple(r) for r in faults.collect()) == [(2, "first", "grade"), (2, "second", "twice"), (3, "second", "missing")]
    marks = spark.createDataFrame([(1, 2), (1, 9)], "book_id int, page int")
    texts = spark.createDataFrame([(1, "ab\fcd\fe")], "book_id int, text string")
    assert sorted((r.page, r.char_start) for r in spans.page_starts(marks, texts, "book_id", "page", "text").collect()) == [(2, 3), (9, None)]


def test_freshness_state(spark, tmp_path):
    from lectern.streaming import pipelines

    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (1, None), (2, None)], "book_id long, last_modified string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("book_id long, last_modified string").parquet(src)
    query = pipelines.freshness(stream).writeStream.format("memory").queryName("fresh").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("fresh").collect()] == [(1, "a", False)]


def test_streams(spark, tmp_path):
    from lectern.streaming import pipelines

    schema = "book_id long, text string, last_modified string"
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/table"
    for i, rows in enumerate(([(1, "a", "1"), (2, "b", "1")], [(1, "c", "2"), (3, "d", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        pipelines.upserts(spark.readStream.schema(schema).parquet(f"file://{src}"), out, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted((r.book_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "c"), (2, "b"), (3, "d")]

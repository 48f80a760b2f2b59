"""An index that follows its books equals one that is built at once."""

from pyspark.sql import functions as F

from lectern.operators.library import Library

SCHEMA = "book_id long, title string, text string, last_modified string"
TEXTS = {i: f"# Chapter one\n{'The red fox ran over hills. ' * (5 + i)}\n# Next part\n{'Dogs were running there. ' * (8 + i)}\n" for i in range(8)} | {8: "Это было давно, рыба плыла в море. " * 9, 9: None, 10: ""}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def books(spark, ids, stamp="1", title="Running dogs", text=None):
    return frame(spark, [(i, f"{title} {i}", text or TEXTS[i], stamp) for i in ids])


def actions(update):
    return {r.book_id: r.action for r in update.plan.collect()}


def contents(library):
    out = {}
    for name, order in (("books", ["book_id"]), ("chunks", ["book_id", "seq"]), ("sections", ["book_id", "position"]), ("vectors", ["book_id", "chunk_id"]), ("postings", ["chunk_id", "col", "term"])):
        df = library.read(name)
        out[name] = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    out["scores"] = {r.chunk_id: round(r.score, 9) for r in library.scores(["run", "dog", "fox", "рыб"]).collect()}
    return out


def test_updates_equal_a_full_build(spark, tmp_path):
    library = Library(spark, str(tmp_path / "a"), budget=120)
    assert set(actions(library.update(books(spark, range(11), text=None))).values()) == {"replace"}
    second = frame(spark, [(0, "Running dogs 0", TEXTS[0], "1"), (1, "New name", TEXTS[1], "2"), (2, "Running dogs 2", "A new text about the red fox. " * 9, "2"), (3, "Running dogs 3", TEXTS[3] + "\n", "2"), (20, "Added", "Foxes run. " * 20, "1")])
    got = library.update(second, removed=spark.createDataFrame([(7,), (99,)], "book_id long"))
    assert actions(got) == {0: "skip", 1: "refresh", 2: "replace", 3: "replace", 20: "replace"}
    sizes = [s.rows for s in got.snapshot.segments]
    assert sizes == [11, 4]  # only what changed was written
    full = Library(spark, str(tmp_path / "b"), budget=120)
    rest = books(spark, [i for i in range(11) if i not in (0, 1, 2, 3, 7)])
    full.update(rest.unionByName(second))
    assert contents(library) == contents(full)
    library.table.merge(everything=True)
    assert contents(library) == contents(full) and len(library.table.snapshot().segments) == 1
    assert {r.title for r in library.read("sections").where("book_id = 0").collect()} == {"Chapter one", "Next part"}


def test_vectors_are_preserved_and_filled_in(spark, tmp_path):
    library = Library(spark, str(tmp_path / "a"), budget=200)
    library.update(books(spark, [0, 1, 2]), embed=True)
    assert actions(library.update(books(spark, [0, 1], stamp="2", text="other text " * 20))) == {0: "preserve", 1: "preserve"}
    assert actions(library.update(books(spark, [0, 1], stamp="2"))) == {0: "refresh", 1: "refresh"}
    assert library.read("vectors").select("book_id").distinct().count() == 3
    library.update(books(spark, [3]))
    assert actions(library.update(books(spark, [2, 3]), embed=True)) == {2: "skip", 3: "replace"}
    n = library.read("books").agg(F.sum("chunk_count").alias("c"), F.sum("embedded_chunks").alias("e")).first()
    assert n.c == n.e == library.read("vectors").count() == library.read("chunks").count()
    assert actions(library.update(books(spark, [3]), embed=True, force=True)) == {3: "replace"}


def test_prune(spark, tmp_path):
    library = Library(spark, str(tmp_path / "a"))
    library.update(books(spark, [0, 1, 2]))
    library.prune(spark.createDataFrame([(1,)], "book_id long"))
    assert {r.book_id for r in library.read("chunks").collect()} == {1} and library.read("books").count() == 1
    full = Library(spark, str(tmp_path / "b"))
    full.update(books(spark, [1]))
    assert contents(library) == contents(full)

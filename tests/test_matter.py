"""Kinds of matter: the columns against the plain rules, and headings of every shape."""

import random

from pyspark.sql import functions as F

from lectern.functions import titles
from lectern.operators import matter, structure

LINES = [
    "Chapter 2 The start", "term, 12", "another term, 3-5", "Intro ..... iv", "A long line of prose that goes on for many words and does not stop before sixty signs", "A line of middle length here", "short", "Contents", "Оглавление", "References",
    "Smith, J. (1999). A title. pp. 3", "doi:10.1/x", "All rights reserved.", "One two three four five six. And here, are some more words now!", "Глава 3. Сети", "“Quoted” text", "Title Case Line", "12 34", "the isbn 123", "   ", "- item",
]


def test_columns_equal_the_plain_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        few = rng.sample(LINES, rng.randint(1, 4))
        body = "\n".join(rng.choice(few if rng.random() < 0.7 else LINES) for _ in range(rng.randint(0, 14)))
        heading = rng.choice([None, "Index", "References", "Chapter 1", "Preface"])
        rows.append((i, body, rng.choice([0.01, 0.5, 0.9]), rng.random() < 0.2, heading))
    df = spark.createDataFrame(rows, "id int, body string, position double, front boolean, heading string").withColumn("above", titles.matter_titles("heading"))
    got = {r.id: (r.matter_kind, r.strong) for r in matter.with_kind(df, "body", F.col("position"), F.col("front"), "above").collect()}
    want = {}
    for i, body, position, front, heading in rows:
        k = matter.kind(body, position, front, heading or "")
        want[i] = (k, matter.is_strong(k, body))
    assert got == want and {k for k, _ in got.values()} == {"front", "back_index", "back_biblio", "back_other", "body"} and {s for _, s in got.values()} == {True, False}


def test_headings():
    text = "# One\nbody\n\n  ## Two ##\n```\n# code\n```\nThree\n=====\nFour\n--\nnot long\n---------\n----\n----\n### 5 no\n=== Six ===\n~~~\nSeven\n=====\n"
    assert structure.headings(text) == [(1, "One", 0), (2, "Two", text.index("  ## Two")), (1, "Three", text.index("Three")), (2, "not long", text.index("not long")), (3, "Six ===", text.index("=== Six"))]
    assert [t for _, t, _ in structure.structural_chapters("# Only\n## A\n## B\n## a\n# Only\n")] == ["A", "B"]
    assert [t for _, t, _ in structure.structural_chapters("# A\n## B\n")] == ["A", "B"]


def test_front_end():
    body = "text " * 3000
    contents = "# Contents\n# Chapter 1\n# Chapter 2\n"
    book = contents + "# Part I\n# Chapter 1\n" + body + "\n# Chapter 2\n" + body * 3
    assert structure._leading_front(book) == book.index("# Part I")
    book = "# Cover\n## below\nx\n# Preface\n" + "p " * 900 + "\n# Real\n" + body * 5
    assert structure._leading_front(book) == book.index("# Real")
    assert structure._leading_front("x" * 4000 + "\n# Preface\n# Real\n" + body * 5) == 0 and structure._leading_front(body) == 0

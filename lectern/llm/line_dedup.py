"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

A document is its sequence of lines with a word; blank lines between are passed
over.  A *gram* at a line is the shortest run from there of GRAM_WORDS words or
more; a *window* the shortest of RUN_WORDS or more.  Of the grams inside each
window the one of least hash is selected, so two occurrences of any run of
RUN_WORDS words share a selected gram: windows inside it choose alike.  Both lengths are arguments.

1. Selected grams are grouped by hash; those found twice are joined to their lines.
2. They are extended both ways, line by line, over less than RUN_WORDS words a
   side, which is as far as the next common gram can be: a gram with its next or
   previous lines is again one hash, grouped again.
3. Of each such hash the first occurrence, by (doc_id, row, line), stays; lines of the later ones go.

So every line goes that lies in a run of RUN_WORDS words or more which occurred
before, in the same or an earlier document; and no line goes that isn't in a
repeated run of GRAM_WORDS words.  Groups are only ever counted and minimised
with partial aggregation, then joined, so a passage in a third of all documents
is a key that adaptive execution splits.  Texts move in one shuffle, at the end.
A document's matched grams meet its lines once, and each looks at the lines near it only,
so the work is linear in a document's lines.

Defined results: null texts stay null, nothing goes from texts of under
GRAM_WORDS words; line ends are \\n, and blanks around a line don't count; null ids
come first in order; of rows equal in id and text the later ones count as wholly
repeated if they have RUN_WORDS words; other columns stay, but an input column named
n_lines or n_removed gives way to the result's; names starting ``_d_`` are reserved; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import discard, persisted, shared_dir

GRAM_WORDS, RUN_WORDS = 32, 50
_SPACE = r"[\x20\x09-\x0D]+"


def _row_key(text: str, key: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def _lines(df: DataFrame, text: str, key: str, gram_words: int) -> DataFrame:
    """(id, row, lines): lines with a word, each with its hash h, words n and place p."""
    line = F.split(text, "\n")
    words = lambda x: F.size(F.array_remove(F.split(x, _SPACE), ""))
    entry = F.transform(line, lambda x, i: F.struct(F.xxhash64(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).alias("h"), words(x).alias("n"), i.alias("p")))
    out = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_d_id"), _row_key(text, key).alias("_d_row"), F.filter(entry, lambda x: x["n"] > 0).alias("lines"))
    # Equal rows: one of them stands for all.
    return out.where(F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]) >= gram_words).dropDuplicates(["_d_row"])


def _steps(most: str) -> str:
    """Numbers from 0, ``most`` of them: arrays are read place by place, as a slice copies its whole array first."""
    return f"sequence(0, greatest({most}, 1) - 1)"


def _selected(lines: DataFrame, gram_words: int, run_words: int) -> DataFrame:
    """(id, row, gram hash, at, k): selected grams, which begin at line ``at`` and have k lines."""
    step = lambda most: f"if(a.n >= {most}, a, named_struct('n', a.n + lines[i + j].n, 'h', xxhash64(a.h, lines[i + j].h), 'k', a.k + 1))"
    run = lambda most: f"aggregate({_steps(f'least({most}, size(lines) - i)')}, named_struct('n', 0, 'h', 0L, 'k', 0), (a, j) -> {step(most)})"
    places = "sequence(0, size(lines) - 1)"
    grams = lines.withColumn("grams", F.expr(f"transform({places}, i -> {run(gram_words)})")).withColumn("windows", F.expr(f"transform({places}, i -> {run(run_words)})"))
    # Of each full window, the least gram that ends inside it; a gram that runs out of lines is none.
    inside = f"filter({_steps('y.w.k')}, j -> grams[y.i + j].n >= {gram_words} and j + grams[y.i + j].k <= y.w.k)"
    least = f"""transform(filter(transform(windows, (w, i) -> named_struct('w', w, 'i', i)), y -> y.w.n >= {run_words}), y ->
        array_min(transform({inside}, j -> named_struct('h', grams[y.i + j].h, 'at', y.i + j, 'k', grams[y.i + j].k))))"""
    # Windows move on, so those that choose one gram are neighbours.
    once = F.filter("least", lambda x, i: (i == 0) | (x["at"] != F.get("least", i - 1)["at"]))
    return grams.select("_d_id", "_d_row", F.expr(least).alias("least")).select("_d_id", "_d_row", F.explode(once).alias("s")).select("_d_id", "_d_row", F.col("s.h").alias("h"), F.col("s.at").alias("at"), F.col("s.k").alias("k"))


def _extended(matched: DataFrame, run_words: int) -> DataFrame:
    """(id, row, at, e, lo, hi): each matched gram, and it with each number of next or previous lines, as a hash e over lines lo to hi.

    ``matched`` holds a document's lines once, beside the array of its matched grams.
    """
    grow = lambda line, there: f"""aggregate({_steps(f'least({run_words}, {there})')}, named_struct('n', 0, 'h', g.h, 'out', cast(array() as array<bigint>)),
        (a, j) -> if({there} <= 0 or a.n + {line}.n >= {run_words}, named_struct('n', {run_words}, 'h', a.h, 'out', a.out),
            named_struct('n', a.n + {line}.n, 'h', xxhash64(a.h, {line}.h), 'out', concat(a.out, array(xxhash64(a.h, {line}.h)))))).out"""  # noqa: E731
    right = grow("get(lines, g.at + g.k + j)", "(size(lines) - g.at - g.k)")
    left = grow("get(lines, g.at - 1 - j)", "g.at")
    place = lambda i: f"lines[{i}].p"
    every = f"""concat(array(named_struct('at', g.at, 'e', g.h, 'lo', {place('g.at')}, 'hi', {place('g.at + g.k - 1')})),
        transform({right}, (e, i) -> named_struct('at', g.at, 'e', e, 'lo', {place('g.at')}, 'hi', {place('g.at + g.k + i')})),
        transform({left}, (e, i) -> named_struct('at', g.at, 'e', xxhash64(e, 1), 'lo', {place('g.at - i - 1')}, 'hi', {place('g.at + g.k - 1')})))"""
    out = matched.select("_d_id", "_d_row", F.explode(F.expr(f"flatten(transform(grams, g -> {every}))")).alias("x"))
    return out.select("_d_id", "_d_row", "x.at", "x.e", "x.lo", "x.hi")


def repeated(df: DataFrame, text: str = "text", key: str = "doc_id", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(row, ranges): disjoint ranges of lines (lo, hi), counted from 0, that repeat earlier ones."""
    folder = shared_dir(df.sparkSession, "lines")
    lines = persisted(_lines(df, text, key, gram_words), folder, "lines")
    selected = persisted(_selected(lines, gram_words, run_words), folder, "selected")
    twice = selected.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    grams = selected.join(twice, "h").groupBy("_d_row").agg(F.collect_list(F.struct("h", "at", "k")).alias("grams"))
    extended = persisted(_extended(grams.join(lines, "_d_row"), run_words), folder, "extended")
    here = F.struct(F.col("_d_id").alias("a"), F.col("_d_row").alias("b"), F.col("at").alias("c"))
    # The first occurrence of each hash that has several.
    first = extended.groupBy("e").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1").select("e", "first")
    later = extended.join(first, "e").where(~here.eqNullSafe(F.col("first")))
    spans = later.groupBy("_d_row", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Of each range what no range before it covers.
    before = F.max("hi").over(Window.partitionBy("_d_row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    rest = spans.select("_d_row", F.greatest(F.col("lo"), F.coalesce(before + 1, F.col("lo"))).alias("lo"), "hi").where("lo <= hi")
    out = persisted(rest.groupBy("_d_row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), folder, "repeated")
    discard(df.sparkSession, folder, ["lines", "selected", "extended"])
    return out


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The input's rows and columns with repeated runs gone from the text, n_lines (with a word) and n_removed."""
    df = df.drop("n_lines", "n_removed")
    # Joined and numbered by the same key, which the id is a part of: texts are shuffled once.
    joined = df.withColumn("_d_row", _row_key(text, key)).join(repeated(df, text, key, gram_words, run_words).withColumnRenamed("ranges", "_d_ranges"), "_d_row", "left")
    again = F.row_number().over(Window.partitionBy("_d_row").orderBy("_d_row")) > 1
    out = joined.withColumns({"_d_again": again, "_d_lines": F.split(text, "\n")})
    n = F.size("_d_lines")
    has_word = r"[^\x20\x09-\x0D]"
    total = F.size(F.array_remove(F.split(F.col(text), _SPACE), ""))
    gone_lines = F.when(F.col("_d_again") & (total >= run_words), F.sequence(F.lit(0), n - 1)).otherwise(F.flatten(F.transform("_d_ranges", lambda r: F.sequence(r["lo"], r["hi"]))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_d_out")), lambda i: F.get("_d_lines", i))
    out = out.withColumn("_d_out", gone_lines).withColumn("_d_kept", F.when(F.col("_d_out").isNotNull(), kept).otherwise(F.col("_d_lines")))
    worded = lambda c: F.size(F.filter(c, lambda x: x.rlike(has_word)))
    counted = out.withColumns({"n_lines": F.coalesce(worded("_d_lines"), F.lit(0)).cast("long"), "_d_left": F.coalesce(worded("_d_kept"), F.lit(0)).cast("long")})
    text_left = F.when(F.col("_d_out").isNotNull(), F.array_join("_d_kept", "\n")).otherwise(F.col(text))
    return counted.withColumn("n_removed", F.col("n_lines") - F.col("_d_left")).withColumn(text, text_left).select(*df.columns, "n_lines", "n_removed")

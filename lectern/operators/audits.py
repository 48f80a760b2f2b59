"""Audits of a text made from sources: overlap, quotes, compression, headings, leaks, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and limits of the audits.
SHINGLE, QUOTE_WORDS, QUOTE_TOTAL, COMPRESSION, HEADING_SHARE = 8, 25, 200, 20.0, 0.5
BROADCAST_ROWS = 500_000


def prose(text: Column | str) -> Column:
    """Markdown without front matter, code blocks, headings, tables and markup."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    t = F.regexp_replace(t, r"(?s)\A---\n.*?\n---\n", "")
    t = F.regexp_replace(t, r"(?s)```.*?(```|\z)", " ")
    t = F.regexp_replace(t, r"(?m)^(#{1,6} .*|\|.*\|\s*|\s*[-=*_]{3,}\s*)$", " ")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(t, r"[*_`>]", "")


def words(text: Column | str) -> Column:
    """Letters and digits in lower case, split at all else."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(df: DataFrame, key: str, text: str, n: int = SHINGLE, distinct: bool = True) -> DataFrame:
    """(key, shingle hash, position): runs of n words."""
    w = df.select(key, words(text).alias("w")).where(F.size("w") >= n)
    at = F.sequence(F.lit(0), F.size("w") - n)
    runs = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("w", i + 1, n)).alias("s"), i.alias("p")))
    out = w.select(key, F.explode(runs).alias("x")).select(key, F.col("x.s").alias("shingle"), F.col("x.p").alias("position"))
    return out.groupBy(key, "shingle").agg(F.min("position").alias("position")) if distinct else out


def overlap(output: DataFrame, sources: DataFrame, key: str, text: str, source_key: str, source_text: str, n: int = SHINGLE, allow: tuple[str, ...] = (), markdown: bool = False) -> DataFrame:
    """(key, source, shared): distinct shingles that a text shares with each source, except those of allowed phrases.

    The sources' shingles are made distinct first and meet the texts' before these are, so of the
    texts only what is shared is ever grouped.  If there are few, which a count says, they are broadcast and no
    shingle of a text is shuffled; else both sides are.  ``markdown`` looks at the prose of the texts only.
    """
    theirs = shingles(sources, source_key, source_text, n).select(source_key, "shingle")
    if allow:
        phrases = output.sparkSession.createDataFrame([(0, a) for a in allow], "_k int, _t string")
        theirs = theirs.join(shingles(phrases, "_k", "_t", n).select("shingle"), "shingle", "left_anti")
    mine = output.select(key, prose(text).alias(text)) if markdown else output
    few = theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = shingles(mine, key, text, n, distinct=False).join(F.broadcast(theirs) if few else theirs, "shingle")
    return met.groupBy(key, source_key, "shingle").agg(F.lit(1).alias("_one")).groupBy(key, source_key).agg(F.count("*").alias("shared"))


def quotes(text: Column | str) -> Column:
    """Quoted spans and block quotes."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # Each kind on its own, so a span's ends match.
    spans = [F.regexp_extract_all(t, F.lit(p), 1) for p in ('"([^"\\n]+)"', "“([^”]+)”", "«([^»]+)»")]
    block = F.transform(F.regexp_extract_all(t, F.lit(r"((?:^|\n)>[^\n]*(?:\n>[^\n]*)*)"), 1), lambda b: F.regexp_replace(b, r"\n?>", " "))
    return F.concat(*spans, block)


def quote_budget(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, longest, total, ok): words of the longest quote and of all."""
    sizes = F.transform(quotes(text), lambda q: F.size(words(q)))
    out = df.select(key, sizes.alias("n")).select(key, F.coalesce(F.array_max("n"), F.lit(0)).alias("longest"), F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("total"))
    return out.withColumn("ok", (F.col("longest") <= QUOTE_WORDS) & (F.col("total") <= QUOTE_TOTAL))


def compression(df: DataFrame, key: str, source_words: str, output_words: str) -> DataFrame:
    """(key, ratio, ok): how much shorter an output is than what it was made from; one of length 0 has ratio 0."""
    ratio = F.when(F.col(output_words) > 0, F.col(source_words) / F.col(output_words)).otherwise(0.0)
    return df.select(key, ratio.alias("ratio"), (ratio >= COMPRESSION).alias("ok"))


def chapter_compression(chapters: DataFrame, key: str, source_words: str, output_words: str) -> DataFrame:
    """(key, ratio, n_below, ok): the floor over a whole output and over each of its chapters."""
    own = F.when(F.col(output_words) > 0, F.col(source_words) / F.col(output_words)).otherwise(0.0)
    by = chapters.groupBy(key).agg(F.sum(source_words).alias("_a"), F.sum(output_words).alias("_b"), F.sum((own < COMPRESSION).cast("int")).alias("n_below"))
    ratio = F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).otherwise(0.0)
    return by.select(key, ratio.alias("ratio"), "n_below", ((ratio >= COMPRESSION) & (F.col("n_below") == 0)).alias("ok"))


def heading_mirror(output: DataFrame, source: DataFrame, key: str, heading: str, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(key, share, ok): share of a text's headings that the source has too, some exempt."""
    norm = lambda c: F.array_join(words(c), " ")
    mine = output.select(key, norm(heading).alias("h")).where((F.col("h") != "") & ~F.col("h").isin(*exempt or ("",)))
    theirs = source.select(key, norm(heading).alias("h"), F.lit(1).alias("hit")).distinct()
    share = F.avg(F.coalesce("hit", F.lit(0)))
    return mine.join(theirs, [key, "h"], "left").groupBy(key).agg(share.alias("share")).withColumn("ok", F.col("share") <= HEADING_SHARE)


def cursor_leak(text: Column | str) -> Column:
    """Whether a text holds a paging cursor or a placeholder for one."""
    t = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9_-]{16,})"), 1)
    plain = lambda r: F.translate(r, "-_", "+/")
    padded = lambda r: F.concat(plain(r), F.repeat(F.lit("="), (4 - F.length(r) % 4) % 4))
    decoded = lambda r: F.try_to_binary(padded(r), F.lit("base64")).cast("string")
    is_cursor = lambda r: F.coalesce(decoded(r).contains('"offset"') & decoded(r).contains('"id"') & decoded(r).contains('"format"'), F.lit(False))
    return t.rlike(r"\{\{[^}]*CURSOR[^}]*\}\}") | F.exists(runs, is_cursor)


# How a text names an ISBN, an author or edition, and where to get the source.
ISBN_NAMED, AUTHOR_NAMED = r"(?i)\bISBN\b|\b97[89][\d\s-]{10,17}\b", r"(?i)\b(author|by|edition)\b|—\s*[A-ZА-ЯЁ]"
BUY_NAMED = r"(?i)\b(buy|purchase|consider buying|own the book|support the author|acquire)\b"


def attribution(text: Column | str) -> Column:
    """Whether a text names an ISBN, an author or edition, and where to get the source."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike(ISBN_NAMED) & t.rlike(AUTHOR_NAMED) & t.rlike(BUY_NAMED), F.lit(False))


def gate(findings: DataFrame, key: str) -> DataFrame:
    """(key, passed, failed checks) of rows (key, check, ok)."""
    return findings.groupBy(key).agg(F.bool_and("ok").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("check")))).alias("failed"))

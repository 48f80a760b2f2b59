"""Retrieval metrics, agreement, and significance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(hits: DataFrame, relevant: DataFrame, query: str = "qid", item: str = "item", k: int = 10, recall_at: int = 5) -> DataFrame:
    """(qid, hit1, recall, rr, ndcg): first credit for each relevant item; recall is capped at the smaller of k and what is relevant."""
    n = relevant.groupBy(query).agg(F.count_distinct(item).alias("n"))
    found = hits.where(F.col("rank") <= k).join(relevant.select(query, item).distinct(), [query, item], "left_semi").groupBy(query, item).agg(F.min("rank").alias("rank"))
    gains = found.groupBy(query).agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= recall_at, 1).otherwise(0)).alias("near"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    out = n.join(gains, query, "left")
    return out.select(query, F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("hit1"), (F.coalesce("near", F.lit(0)) / F.least("n", F.lit(recall_at))).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def mean_metrics(by_query: DataFrame, *group: str) -> DataFrame:
    return by_query.groupBy(*group).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("hit1", "recall", "rr", "ndcg")))


def graded_ndcg(hits: DataFrame, grades: DataFrame, query: str = "qid", item: str = "item", k: int = 5) -> DataFrame:
    """nDCG with gain 2^grade - 1 against the ideal order of all grades."""
    gain = F.pow(F.lit(2.0), F.greatest(F.col("grade"), F.lit(0))) - 1
    got = hits.where(F.col("rank") <= k).join(grades, [query, item]).groupBy(query).agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(F.col("grade").desc(), item))).where(F.col("r") <= k).groupBy(query).agg(F.sum(gain / F.log2(F.col("r") + 1.0)).alias("ideal"))
    return best.join(got, query, "left").select(query, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def auc(df: DataFrame, score: str, label: str, parts: int = 1024) -> DataFrame:
    """Area under the curve by average ranks of tied scores; null if a side is empty.

    Scores are counted, then ranked within ``parts`` ranges of theirs whose totals alone come together, so no task sees them all.
    """
    by = df.groupBy(score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))  # one row
    width = F.nullif(F.col("hi").cast("double") - F.col("lo"), F.lit(0.0))
    ranged = by.join(F.broadcast(ends)).withColumn("part", F.coalesce(F.floor((F.col(score) - F.col("lo")) / width * parts).cast("int"), F.lit(0)))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("t"))  # at most ``parts`` + 1 rows
    starts = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + inside + (F.col("n") + 1) / 2.0)
    out = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return out.select(F.when((p > 0) & (q > 0), (F.col("s") - p * (p + 1) / 2.0) / (p * q)).alias("auc"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two gradings; 1 if chance agreement is full, null without rows."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t"), F.sum((F.col(a) == F.col(b)).cast("int")).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("x")), cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.join(chance).select(F.when(F.col("t") > 0, F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))).alias("kappa"))


def resolved(first: DataFrame, second: DataFrame, adjudicator: DataFrame, key: str) -> DataFrame:
    """(key, grade, disputed, missing): two judges' common grade, else the adjudicator's."""
    g = lambda d, n: d.select(key, F.col("grade").alias(n))
    out = g(first, "a").join(g(second, "b"), key, "left").join(g(adjudicator, "c"), key, "left")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return out.select(key, F.when(same, F.col("a")).otherwise(F.col("c")).alias("grade"), (~same).alias("disputed"), (~same & F.col("c").isNull()).alias("missing"))


def percentile_nearest(column: str, q: float) -> Column:
    """Nearest rank: the ceil(q n)-th value."""
    return F.expr(f"percentile_disc({q}) within group (order by {column})")


def low_median(column: str) -> Column:
    """The lower of the two middle values; an aggregate over counts by value."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column})")


def median(column: str) -> Column:
    return F.percentile(column, 0.5)


def quartile_cuts(df: DataFrame, column: str, *group: str) -> DataFrame:
    """(group, cuts): values at floor(n i / 4) of the sorted column, counted from 0, i = 1 to 3; from counts by value."""
    by = df.groupBy(*group, column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    at = by.withColumns({"_to": F.sum("_n").over(w), "_all": F.sum("_n").over(whole)})
    hit = lambda i: F.min(F.when(F.col("_to") > F.floor(F.col("_all") * i / 4), F.col(column)))
    return at.groupBy(*group).agg(F.array(*(hit(i) for i in (1, 2, 3))).alias("cuts"))


def coverage_split(df: DataFrame, grade: str, tag: str) -> DataFrame:
    """(tag, grade, n): how many items of each tag have each grade; no grade is null."""
    return df.groupBy(tag, grade).agg(F.count("*").alias("n"))


def hole_at(hits: DataFrame, k: int, query: str = "qid", grade: str = "grade") -> DataFrame:
    """Share of the first k hits without a grade."""
    return hits.where(F.col("rank") <= k).groupBy(query).agg(F.avg(F.col(grade).isNull().cast("double")).alias("hole"))


def judged_metrics(df: DataFrame, query: str = "qid") -> DataFrame:
    """hit@1, 3, 5, misses, MRR and precision at 5 for grade 2."""
    good = F.coalesce(F.col("grade") == 2, F.lit(False))
    by = df.groupBy(query).agg(F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.when(good & (F.col("rank") <= 5), 1).otherwise(0)).alias("near"))
    hit = lambda k: F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"hit{k}")
    return by.agg(hit(1), hit(3), hit(5), F.avg(F.col("first").isNull().cast("double")).alias("total_miss"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("near") / 5.0).alias("p5"))


def regressions(now: DataFrame, baseline: DataFrame, keys: list[str], report_only: tuple[str, ...] = ()) -> DataFrame:
    """Baseline queries that hit at rank 1 and don't now; a missing query is broken."""
    out = baseline.where("hit1 = 1").join(now.select(*keys, F.col("hit1").alias("now")), keys, "left").where(F.coalesce("now", F.lit(0.0)) < 1)
    return out.where(~F.col("kind").isin(*report_only)) if report_only else out


def floor_sweep(rows: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, flagged_good, flagged_bad): how many rows each rerank floor would flag."""
    return rows.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))).groupBy("floor").agg(F.sum(((F.col("score") < F.col("floor")) & F.col("good")).cast("int")).alias("flagged_good"), F.sum(((F.col("score") < F.col("floor")) & ~F.col("good")).cast("int")).alias("flagged_bad"))


def blended(pool: DataFrame, alpha: float, query: str = "qid", item: str = "item") -> DataFrame:
    """Fused and rerank scores scaled to [0, 1] within a query and mixed."""
    w = Window.partitionBy(query)
    scale = lambda c: F.coalesce((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0)), F.lit(0.0))
    mixed = pool.withColumn("blend", alpha * scale("rerank") + (1 - alpha) * scale("fused"))
    return mixed.withColumn("rank", F.row_number().over(w.orderBy(F.col("blend").desc(), item)))


def mulberry32(seed: int):
    """A small deterministic generator of doubles in [0, 1)."""
    # Fixed values below: the published constants of the generator.
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t = (t ^ (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF))) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296.0

    return draw


def sign_test(wins: int, losses: int) -> float:
    n, k = wins + losses, min(wins, losses)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def permutation_p(diffs: list[float], seed: int = 0x358, rounds: int = 10_000) -> float:
    """Two-sided paired permutation test of the mean: exact up to 12 pairs that differ, else by simulation."""
    d = np.array([x for x in diffs if x], float)
    if not len(d):
        return 1.0
    seen = abs(d.sum()) - 1e-12
    if len(d) <= 12:
        signs = 1 - 2 * ((np.arange(2 ** len(d))[:, None] >> np.arange(len(d))) & 1)
        return float((np.abs(signs @ d) >= seen).mean())
    draw = mulberry32(seed)
    hits = sum(abs(sum(x if draw() < 0.5 else -x for x in d)) >= seen for _ in range(rounds))
    return (hits + 1) / (rounds + 1)


def bootstrap_ci(diffs: list[float], seed: int = 0x358, rounds: int = 2000, level: float = 0.95) -> tuple[float, float]:
    if not diffs:
        return float("nan"), float("nan")
    draw, n = mulberry32(seed), len(diffs)
    means = sorted(sum(diffs[int(draw() * n)] for _ in range(n)) / n for _ in range(rounds))
    cut = (1 - level) / 2
    return means[int(cut * rounds)], means[min(rounds - 1, int((1 - cut) * rounds))]


def folds(items: DataFrame, key: str, stratum: str, k: int = 5) -> DataFrame:
    """Items with a fold from 0 to k - 1: dealt in turn within each stratum, in order of a hash of the key."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(0x358), key), key)) - 1
    return items.withColumn("fold", F.pmod(turn, F.lit(k)))


def stratified(items: DataFrame, key: str, stratum: str, each: int) -> DataFrame:
    """The first ``each`` items of every stratum, in order of a hash of the key."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(0x358), key), key))
    return items.withColumn("_r", turn).where(F.col("_r") <= each).drop("_r")


def leave_one_out(rows: DataFrame, metric: str, *group: str) -> DataFrame:
    """Rows with ``without``: the mean of the metric over all other rows of the group; null for a lone one."""
    totals = rows.groupBy(*group).agg(F.sum(metric).alias("_s"), F.count(metric).alias("_n"))
    both = rows.join(totals, list(group)) if group else rows.join(F.broadcast(totals))
    return both.withColumn("without", (F.col("_s") - F.coalesce(metric, F.lit(0.0))) / F.nullif(F.col("_n") - F.col(metric).isNotNull().cast("long"), F.lit(0))).drop("_s", "_n")


def spans_matched(hits: DataFrame, labels: DataFrame, query: str = "qid", least: float = 0.3) -> DataFrame:
    """(qid, label_id, rank): the first hit of a label's book whose span covers ``least`` of the label's span."""
    lab = labels.select(query, "label_id", "book_id", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    shared = F.least("char_end", "_e") - F.greatest("char_start", "_s")
    met = hits.join(lab, [query, "book_id"]).where((shared > 0) & (shared >= least * (F.col("_e") - F.col("_s"))))
    return met.groupBy(query, "label_id").agg(F.min("rank").alias("rank"))


def figures_matched(hits: DataFrame, labels: DataFrame, query: str = "qid") -> DataFrame:
    """(qid, label_id, rank): the first hit that is a label's figure (book_id, index); null if none is."""
    met = labels.join(hits.select(query, "book_id", "index", "rank"), [query, "book_id", "index"], "left")
    return met.groupBy(query, "label_id").agg(F.min("rank").alias("rank"))


def localised(hits: DataFrame, labels: DataFrame, query: str = "qid") -> DataFrame:
    """(qid, rank): the first passage that overlaps the label's span and holds its marker text, in either case."""
    lab = labels.select(query, "book_id", "marker", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    met = hits.join(lab, [query, "book_id"]).where((F.col("char_start") < F.col("_e")) & (F.col("char_end") > F.col("_s")) & F.contains(F.lower("body"), F.lower("marker")))
    return met.groupBy(query).agg(F.min("rank").alias("rank"))


def by_length(rows: DataFrame, length: str, metric: str) -> DataFrame:
    """(bucket, n, mean): a metric by quarter of length; a value at a cut belongs to the quarter above it."""
    cuts = quartile_cuts(rows, length)  # one row
    bucket = F.size(F.filter("cuts", lambda c: c <= F.col(length)))
    return rows.join(F.broadcast(cuts)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))


def violations(first: DataFrame, second: DataFrame, key: str, grades: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(key, judge, fault): grades that are none of the scale, and items that a judge has twice or left out."""
    side = lambda d, n: d.groupBy(key).agg(F.count("*").alias("n"), F.bool_or(~F.coalesce(F.col("grade").isin(*grades), F.lit(False))).alias("odd")).withColumn("judge", F.lit(n))
    one, two = side(first, "first"), side(second, "second")
    lost = one.join(two, key, "left_anti").select(key, F.lit("second").alias("judge"), F.lit("missing").alias("fault")).unionByName(two.join(one, key, "left_anti").select(key, F.lit("first").alias("judge"), F.lit("missing").alias("fault")))
    own = one.unionByName(two)
    return own.where("odd").select(key, "judge", F.lit("grade").alias("fault")).unionByName(own.where("n > 1").select(key, "judge", F.lit("twice").alias("fault"))).unionByName(lost)


def tier_gate(report: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(check, value, ok) of a run without reranking (mode, reranked, metric, value): it must not be reranked, and each metric must reach its floor."""
    used = report.agg(F.max(F.col("reranked").cast("int")).alias("r")).select(F.lit("rerank off").alias("check"), F.col("r").cast("double").alias("value"), (F.col("r") == 0).alias("ok"))
    wanted = F.create_map(*(x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))))
    held = report.where(F.col("metric").isin(*floors)).select(F.concat_ws(" ", "mode", "metric").alias("check"), F.col("value").cast("double").alias("value"), (F.col("value") >= wanted[F.col("metric")]).alias("ok"))
    return used.unionByName(held)


def axes(rows: DataFrame, k: int = 5) -> DataFrame:
    """One row per mode: share of span hits within k, of snippets with their marker, of false low-confidence flags, of confusers first, latencies."""
    share = lambda when, of: F.sum(F.when(of & when, 1).otherwise(0)) / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0))
    every = F.lit(True)
    return rows.groupBy("mode").agg(
        share(F.coalesce(F.col("span_rank") <= k, F.lit(False)), F.col("positive")).alias("span_hit"), share(F.coalesce(F.col("marker"), F.lit(False)), F.col("marker").isNotNull()).alias("snippet_marker"),
        share(F.col("flagged"), F.col("positive")).alias("false_flags"), share(F.coalesce(F.col("confuser_rank") == 1, F.lit(False)), every).alias("confuser_first"),
        percentile_nearest("ms", 0.5).alias("p50"), percentile_nearest("ms", 0.95).alias("p95"),
    )


def saturated(means: DataFrame, metric: str, floor: float = 0.95) -> DataFrame:
    """(category, saturated, headroom): whether all modes of a category reach the floor, and what the weakest lacks to 1."""
    return means.groupBy("category").agg(F.bool_and(F.col(metric) >= floor).alias("saturated"), (1 - F.min(metric)).alias("headroom"))


def list_changes(now: DataFrame, baseline: DataFrame, allowed: DataFrame, keys: list[str], item: str = "item", k: int = 10) -> DataFrame:
    """(keys, change) of queries whose first k items are not the baseline's: broken, allowed, or a stale entry of the allowed list.

    ``allowed`` has the keys, the exact new list and a reason; an entry without a reason, or that nothing matches, fails.
    """
    lists = lambda d, name: d.where(F.col("rank") <= k).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias(name))
    both = lists(now, "a").join(lists(baseline, "b"), keys, "full_outer").join(allowed.select(*keys, "items", "reason"), keys, "left")
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    covered = F.col("items").eqNullSafe(F.col("a")) & F.coalesce(F.btrim("reason") != "", F.lit(False))
    change = F.when(differ & F.col("items").isNotNull() & covered, "allowed").when(differ, "broken").when(F.col("items").isNotNull(), "stale")
    return both.select(*keys, change.alias("change")).where("change is not null")


def trap(hits: DataFrame, query: str = "qid") -> DataFrame:
    """(qid, non_body_above): hits outside a book's text that stand before its first body hit."""
    first = F.min(F.when(F.col("body"), F.col("rank"))).over(Window.partitionBy(query))
    return hits.withColumn("_first", first).groupBy(query).agg(F.sum(F.when(~F.col("body") & (F.col("_first").isNull() | (F.col("rank") < F.col("_first"))), 1).otherwise(0)).alias("non_body_above"))


def judgments_to_hits(judgments: DataFrame, hits: DataFrame, query: str = "qid") -> DataFrame:
    """(qid, hit_id, judgment_id): judgments given to hits of their book by overlap of spans, each used once.

    Spans match that share half of the shorter one; a point matches an equal point.  Per query, the best pairs first: most
    overlap, newest date, nearest span, latest record.  Only a query's matching pairs come together.
    """
    j = judgments.select(query, "judgment_id", "book_id", "date", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    shared = F.least("char_end", "_e") - F.greatest("char_start", "_s")
    shorter = F.least(F.col("char_end") - F.col("char_start"), F.col("_e") - F.col("_s"))
    equal = (F.col("char_start") == F.col("_s")) & (F.col("char_end") == F.col("_e"))
    fits = F.when(shorter > 0, (shared * 2 >= shorter) & (shared > 0)).otherwise(equal)
    met = hits.join(j, [query, "book_id"]).where(fits)
    far = F.abs(F.col("char_start") - F.col("_s")) + F.abs(F.col("char_end") - F.col("_e"))
    pairs = met.select(query, "hit_id", "judgment_id", shared.alias("shared"), "date", far.alias("far"))

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["shared", "date", "far", "judgment_id"], ascending=[False, False, True, False], kind="stable")
        taken_h, taken_j, out = set(), set(), []
        for r in ordered.itertuples():
            if r.hit_id not in taken_h and r.judgment_id not in taken_j:
                taken_h.add(r.hit_id)
                taken_j.add(r.judgment_id)
                out.append((getattr(r, query), r.hit_id, r.judgment_id))
        return pd.DataFrame(out, columns=[query, "hit_id", "judgment_id"])

    kind = lambda d, c: d.schema[c].dataType.simpleString()
    return pairs.groupBy(query).applyInPandas(assign, f"{query} {kind(hits, query)}, hit_id {kind(hits, 'hit_id')}, judgment_id {kind(judgments, 'judgment_id')}")


def rrf_sweep(lists: list[DataFrame], relevant: DataFrame, weights: list[tuple[float, ...]], query: str = "qid", item: str = "item") -> DataFrame:
    """(weights, hit1, recall, rr, ndcg): mean metrics of fused lists under each choice of weights."""
    from .fusion import rrf

    out = None
    for w in weights:
        fused = rrf(lists, [query, item], list(w))
        ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("fused").desc(), item)))
        one = mean_metrics(query_metrics(ranked, relevant, query, item).withColumn("weights", F.lit(",".join(f"{x:g}" for x in w))), "weights")
        out = one if out is None else out.unionByName(one)
    return out


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two word lists."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def compared(a: DataFrame, b: DataFrame, metric: str, key: str = "qid", group: str = "mode") -> DataFrame:
    """(mode, n, mean difference, p, interval) of two reports over the same queries."""
    both = a.select(key, group, F.col(metric).alias("x")).join(b.select(key, group, F.col(metric).alias("y")), [key, group])

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        d = (rows.sort_values(key).y - rows.sort_values(key).x).tolist()
        lo, hi = bootstrap_ci(d)
        return pd.DataFrame({group: [rows[group].iloc[0]], "n": [len(d)], "diff": [float(np.mean(d))], "p": [permutation_p(d)], "lo": [lo], "hi": [hi]})

    return both.groupBy(group).applyInPandas(test, f"{group} string, n long, diff double, p double, lo double, hi double")

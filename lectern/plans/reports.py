"""Queries of evaluation reports over ``events`` and ``labels``, and of an index that follows its books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import evaluation
from lectern.operators.library import Library

from .catalogues import _judged
from .tables import scratch_folder, table


def ir_means(spark, sf_dir):
    """Mean metrics of users' hits by the last digit of the user."""
    hits, relevant = _judged(spark, sf_dir)
    by = evaluation.query_metrics(hits, relevant).withColumn("mode", F.col("qid") % 10)
    means = evaluation.mean_metrics(by, "mode")
    return means.select("mode", "n", *(F.round(c, 3).alias(c) for c in ("hit1", "recall", "rr", "ndcg")))


def rrf_sweep(spark, sf_dir):
    """Two orders of users' events fused under three choices of weights."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"), "value")
    ranked = lambda *order: e.select("qid", "item", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).alias("rank"))
    _, relevant = _judged(spark, sf_dir)
    out = evaluation.rrf_sweep([ranked(F.col("value").desc(), "item"), ranked("item")], relevant, [(1.0, 1.0), (1.0, 0.0), (0.25, 1.0)])
    return out.select("weights", "n", *(F.round(c, 3).alias(c) for c in ("hit1", "recall", "rr", "ndcg")))


def _grades(spark, sf_dir):
    d = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q is not null and t is not null")
    first = d.select("doc_id", F.col("q").alias("grade"))
    second = d.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("t") + 3).otherwise(F.col("t")).alias("grade"))
    return first, second.unionByName(second.where("doc_id % 13 = 0")), d.where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("grade"))


def judges(spark, sf_dir):
    """Two gradings of documents and an adjudicator's."""
    first, second, third = _grades(spark, sf_dir)
    return evaluation.resolved(first, second.distinct(), third, "doc_id").select("doc_id", "grade", "disputed", "missing")


def judge_faults(spark, sf_dir):
    first, second, _ = _grades(spark, sf_dir)
    return evaluation.violations(first, second, "doc_id")


def fold_sizes(spark, sf_dir):
    """Customers dealt into five folds within their segment, and a stratified sample: how many of each."""
    c = table(spark, sf_dir, "customer")
    dealt = evaluation.folds(c, "c_custkey", "c_mktsegment").groupBy("c_mktsegment", F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n"))
    some = evaluation.stratified(c, "c_custkey", "c_mktsegment", 70).groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("c_mktsegment", F.lit(-1).alias("fold"), "n")
    return dealt.unionByName(some)


def leave_one_out(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return evaluation.leave_one_out(e, "value", "event_type").select("event_id", F.round("without", 4).alias("without"))


def eval_axes(spark, sf_dir):
    """Events as answers of search modes: shares of good spans, markers, flags and confusers, and latencies."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), (i % 9 + 1).alias("span_rank"), (i % 2 == 0).alias("positive"), F.when(i % 3 > 0, i % 5 == 1).alias("marker"), (F.col("value") < 10).alias("flagged"), (i % 4).alias("confuser_rank"), F.col("value").alias("ms"))
    return evaluation.axes(rows).select("mode", *(F.round(c, 6).alias(c) for c in ("span_hit", "snippet_marker", "false_flags", "confuser_first", "p50", "p95")))


def saturation(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("category"), "event_type").agg((F.count(F.when(F.col("value") < 60, 1)) / F.count("*")).alias("m"))
    return evaluation.saturated(e, "m", 0.9).select("category", "saturated", F.round("headroom", 6).alias("headroom"))


def list_changes(spark, sf_dir):
    """Users' ten best events against a baseline that orders every fifth user's by id, some of them allowed."""
    hits, _ = _judged(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"))
    other = e.where("qid % 5 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("item")))
    baseline = hits.where("qid % 5 <> 0").unionByName(other.select(*hits.columns))
    now = hits.where("rank <= 10").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
    allowed = now.where("qid % 10 = 0 or qid % 17 = 1").withColumn("reason", F.when(F.col("qid") % 20 == 0, " ").otherwise("better order"))
    return evaluation.list_changes(hits, baseline, allowed, ["qid"])


def blend_ranks(spark, sf_dir):
    """Two scores of users' events scaled within the user and mixed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"), F.col("value").alias("rerank"), (F.lit(1.0) / (F.col("event_id") % 50 + 1)).alias("fused"))
    return evaluation.blended(e, 0.3).select("qid", "item", F.round("blend", 6).alias("blend"), "rank")


def library_update(spark, sf_dir):
    """Documents as books, part of them indexed before with older texts, then brought up to date: what was done to each, and what its chunks hold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"), "text")
    i = F.col("book_id") % 5
    before = docs.where(i != 4).withColumns({"text": F.when(i == 2, F.concat_ws(" ", "text", F.lit("of old"))).otherwise(F.col("text")), "last_modified": F.lit("1")})
    library = Library(spark, scratch_folder(spark, "library"))
    library.update(before)
    done = library.update(docs.withColumn("last_modified", F.when(i == 0, "1").otherwise("2")))
    shown = F.col("body")
    for blank in "\x20\t\n\x0b\f\r":
        shown = F.replace(shown, F.lit(blank), F.lit(""))
    chars = library.read("chunks").groupBy("book_id").agg(F.sum(F.length(shown)).alias("chars"))
    return done.plan.join(chars, "book_id", "left").select("book_id", "action", F.coalesce("chars", F.lit(0)).alias("chars"))


QUERIES = {f.__name__: f for f in (ir_means, rrf_sweep, judges, judge_faults, fold_sizes, leave_one_out, eval_axes, saturation, list_changes, blend_ranks, library_update)}

_REL = "rel AS (SELECT user_id AS qid, event_id AS item FROM events WHERE event_type = 'purchase'), cnt AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid)"
_METRICS = """f AS (SELECT {0} qid, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS near, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM hits JOIN rel USING (qid, item) WHERE rank <= 10 GROUP BY ALL)"""
_MEANS = """count(*) AS n, round(round(avg(CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END), 4), 3) AS hit1, round(round(avg(coalesce(near, 0) / least(cnt.n, 5)::DOUBLE), 4), 3) AS recall, round(round(avg(coalesce(1.0::DOUBLE / first, 0)), 4), 3) AS rr,
 round(round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(cnt.n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))), 4), 3) AS ndcg"""
_GRADES = """d AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1 HAVING max(quality) IS NOT NULL AND max(toxic) IS NOT NULL),
 s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN t + 3 ELSE t END AS g FROM d WHERE doc_id % 11 <> 0)"""

ORACLE_SQL = {
    "ir_means": f"WITH hits AS (SELECT user_id AS qid, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), {_REL}, {_METRICS.format('')} SELECT cnt.qid % 10 AS mode, {_MEANS} FROM cnt LEFT JOIN f USING (qid) GROUP BY 1",
    "rrf_sweep": f"""WITH o AS (SELECT user_id AS qid, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
 w AS (SELECT * FROM (VALUES ('1,1', 1.0::DOUBLE, 1.0::DOUBLE), ('1,0', 1.0, 0.0), ('0.25,1', 0.25, 1.0)) v(weights, x, y)),
 hits AS (SELECT weights, qid, item, row_number() OVER (PARTITION BY weights, qid ORDER BY x / (60 + a) + y / (60 + b) DESC, item) AS rank FROM o, w), {_REL}, {_METRICS.format('weights,')}
 SELECT w.weights, {_MEANS} FROM w CROSS JOIN cnt LEFT JOIN f ON f.qid = cnt.qid AND f.weights = w.weights GROUP BY 1""",
    "judges": f"WITH {_GRADES} SELECT d.doc_id, CAST(CASE WHEN coalesce(d.q = s.g, false) THEN d.q WHEN d.doc_id % 2 = 0 THEN 2 END AS INT) AS grade, NOT coalesce(d.q = s.g, false) AS disputed, NOT coalesce(d.q = s.g, false) AND d.doc_id % 2 <> 0 AS missing FROM d LEFT JOIN s USING (doc_id)",
    "judge_faults": f"WITH {_GRADES} SELECT doc_id, 'second' AS judge, 'grade' AS fault FROM s WHERE g NOT IN (0, 1, 2) UNION ALL SELECT doc_id, 'second', 'twice' FROM s WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'second', 'missing' FROM d WHERE doc_id % 11 = 0",
    "fold_sizes": "WITH n AS (SELECT c_mktsegment, count(*) AS c FROM customer GROUP BY 1) SELECT c_mktsegment, CAST(f AS INT) AS fold, (c + 4 - f) // 5 AS n FROM n, range(5) r(f) WHERE (c + 4 - f) // 5 > 0 UNION ALL SELECT c_mktsegment, -1, least(c, 70) FROM n",
    "leave_one_out": "SELECT event_id, round((sum(value) OVER w - coalesce(value, 0)) / nullif(count(value) OVER w - CASE WHEN value IS NULL THEN 0 ELSE 1 END, 0), 4) AS without FROM events WINDOW w AS (PARTITION BY event_type)",
    "eval_axes": """SELECT event_type AS mode, round(count(*) FILTER (event_id % 2 = 0 AND event_id % 9 < 5) / nullif(count(*) FILTER (event_id % 2 = 0), 0)::DOUBLE, 6) AS span_hit,
  round(count(*) FILTER (event_id % 3 > 0 AND event_id % 5 = 1) / nullif(count(*) FILTER (event_id % 3 > 0), 0)::DOUBLE, 6) AS snippet_marker, round(count(*) FILTER (event_id % 2 = 0 AND value < 10) / nullif(count(*) FILTER (event_id % 2 = 0), 0)::DOUBLE, 6) AS false_flags,
  round(count(*) FILTER (event_id % 4 = 1) / count(*)::DOUBLE, 6) AS confuser_first, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1""",
    "saturation": "WITH m AS (SELECT user_id % 50 AS category, event_type, count(*) FILTER (value < 60) / count(*)::DOUBLE AS m FROM events GROUP BY ALL) SELECT category, bool_and(m >= 0.9) AS saturated, round(1 - min(m), 6) AS headroom FROM m GROUP BY 1",
    "list_changes": """WITH a AS (SELECT user_id AS qid, list(event_id ORDER BY value DESC, event_id)[1:10] AS a, CASE WHEN user_id % 5 = 0 THEN list(event_id ORDER BY event_id)[1:10] ELSE list(event_id ORDER BY value DESC, event_id)[1:10] END AS b FROM events GROUP BY 1),
 c AS (SELECT qid, a <> b AS differ, qid % 10 = 0 OR qid % 17 = 1 AS listed, qid % 20 <> 0 AS reason FROM a)
 SELECT qid, CASE WHEN differ AND listed AND reason THEN 'allowed' WHEN differ THEN 'broken' ELSE 'stale' END AS change FROM c WHERE differ OR listed""",
    "blend_ranks": """WITH e AS (SELECT user_id AS qid, event_id AS item, value AS r, 1.0::DOUBLE / (event_id % 50 + 1) AS f FROM events),
 b AS (SELECT qid, item, 0.3::DOUBLE * coalesce((r - min(r) OVER w) / nullif(max(r) OVER w - min(r) OVER w, 0), 0) + (1 - 0.3::DOUBLE) * coalesce((f - min(f) OVER w) / nullif(max(f) OVER w - min(f) OVER w, 0), 0) AS blend FROM e WINDOW w AS (PARTITION BY qid))
 SELECT qid, item, round(blend, 6) AS blend, CAST(row_number() OVER (PARTITION BY qid ORDER BY b.blend DESC, item) AS INT) AS rank FROM b""",
    "library_update": r"""SELECT doc_id AS book_id, CASE doc_id % 5 WHEN 0 THEN 'skip' WHEN 2 THEN 'replace' WHEN 4 THEN 'replace' ELSE CASE WHEN regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') THEN 'refresh' ELSE 'replace' END END AS action,
 CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS chars FROM documents""",
}

"""Retrieval queries over ``embeddings``, ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import fusion, keyword, spans, vectors

from .tables import scratch_folder, table

QUERY_TERMS = ("tion", "the", "and", "hand", "thing")


def _query_vector(rows: DataFrame, vec_id: int = 0) -> list[float]:
    """One row: the query itself."""
    return list(rows.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.vector_topk(e, _query_vector(e), 10, "vec_id", "embedding", order=("label",)).select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_topk_allow(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.vector_topk(e, _query_vector(e), 10, "vec_id", "embedding", allow=F.col("label").isin(1, 3, 5), order=("label",)).select("vec_id", "label", F.round("score", 6).alias("score"))


def best_per_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scored = e.withColumn("score", vectors.dot("embedding", _query_vector(e))).select("vec_id", "label", "score")
    # Even ids stand for body passages.
    best = vectors.best_per_book(scored.withColumn("body", F.col("vec_id") % 2 == 0), "label", "vec_id", F.col("body"))
    return best.select("label", "vec_id", F.round("score", 6).alias("score"))


_stored: dict[tuple[str, str], str] = {}


def index_of(spark, sf_dir) -> keyword.Index:
    """The keyword index of ``documents``, built once per session and folder, then read: postings sorted by term.

    Two columns: the text as it is, and source and language in the place of title and authors.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stored:
        docs = table(spark, sf_dir, "documents")
        meta = F.concat_ws(" ", "source", "lang")
        folder = scratch_folder(spark, "keyword")
        keyword.stored(docs.select("doc_id", F.col("text").alias("body"), meta.alias("book_meta")), "doc_id", ["body", "book_meta"], folder)
        _stored[at] = folder
    return keyword.opened(spark, "doc_id", _stored[at])


def term_stats(spark, sf_dir):
    return keyword.term_stats(index_of(spark, sf_dir).postings, "doc_id").select("col", "term", "df")


def _bm25(spark, sf_dir, terms=QUERY_TERMS):
    index = index_of(spark, sf_dir)
    return keyword.bm25(index.postings, "doc_id", terms, index.total, index.mean_len)


def bm25_search(spark, sf_dir):
    return keyword.search(index_of(spark, sf_dir), QUERY_TERMS, 10).select("doc_id", F.round(F.round("score", 9), 6).alias("score"))


def bm25_columns(spark, sf_dir):
    """All scores of terms in one column or all, with an identifier form among them."""
    index = index_of(spark, sf_dir)
    terms = [keyword.Term("en", ("book_meta",)), keyword.Term("and"), keyword.Term("the", ("body",)), keyword.Term("node.js")]
    return keyword.bm25(index.postings, "doc_id", terms, index.total, index.mean_len).select("doc_id", F.round(F.round("score", 9), 6).alias("score"))


def bm25_allowed(spark, sf_dir):
    allow = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    return keyword.search(index_of(spark, sf_dir), QUERY_TERMS, 10, allow).select("doc_id", F.round(F.round("score", 9), 6).alias("score"))


def best_passage(spark, sf_dir):
    """Documents as passages of the books that their sources are; even ids stand for body passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book_id"), (F.col("doc_id") % 2 == 0).alias("body")).where("book_id is not null")
    return keyword.best_passages(index_of(spark, sf_dir), docs, QUERY_TERMS, 20).select("book_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def keyword_plan_prune(spark, sf_dir):
    index = index_of(spark, sf_dir)
    df = index.frequencies(QUERY_TERMS, "body")
    plan = keyword.plan_query(" ".join(QUERY_TERMS), df, index.total)
    kept = [t.text for t in plan.terms]
    return spark.createDataFrame([(t, df.get(t, 0), t in kept) for t in QUERY_TERMS], "term string, df long, kept boolean")


def match_build(spark, sf_dir):
    """The terms of some typed queries without statistics, each with how many documents and how many places of the stored index hold it."""
    queries = ("running dogs", "c++ and node.js.", "книги ёлка", "api_v2 camelCase", '"the end" of it', "!?", "la de que")
    rows = [(q, i, t.text) for q in queries for i, t in enumerate(keyword.match_terms(q).terms)]
    terms = spark.createDataFrame(rows, "query string, place int, term string")
    wanted = sorted({t for *_, t in rows})
    held = index_of(spark, sf_dir).postings.where(F.col("term").isin(*wanted)).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("places"))
    return terms.join(F.broadcast(held), "term", "left").select("query", "place", "term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("places", F.lit(0)).cast("long").alias("places"))


def _vector_half(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = vectors.vector_topk(e, _query_vector(e), fusion.POOL, "vec_id", "embedding").select(F.col("vec_id").alias("id"), "score")
    return fusion.ranked(v, F.col("score").desc(), "id")


def _halves(spark, sf_dir):
    """Both halves; who needs vectors only takes that half, as this one builds the keyword index."""
    k = _bm25(spark, sf_dir).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score")).orderBy("score", "id").limit(fusion.POOL)
    return _vector_half(spark, sf_dir), fusion.ranked(k, "score", "id")


def rrf_fuse(spark, sf_dir):
    v, k = _halves(spark, sf_dir)
    return fusion.rrf([v, k], ["id"]).select("id", F.round("fused", 8).alias("fused"))


def hybrid_search(spark, sf_dir):
    v, k = _halves(spark, sf_dir)
    return fusion.hybrid(v, k, ["id"], 20).select("id", "vector_rank", "keyword_rank", "found_by", F.round("fused", 8).alias("fused"))


def admit_prefix(spark, sf_dir):
    v = _vector_half(spark, sf_dir)
    return fusion.admitted(v.withColumn("pairs", F.when(F.col("id") % 3 == 0, 2).otherwise(1)), "pairs", ["rank"]).select("id", "rank")


def confidence(spark, sf_dir):
    v = _vector_half(spark, sf_dir)
    out = fusion.low_confidence(v.select(F.col("score").alias("cosine"), (F.lit(1.0) / (1 + F.col("rank"))).alias("rerank"), (F.col("id") % 2 == 0).alias("body")))
    return out.select(F.round("max_cosine", 6).alias("max_cosine"), F.round("max_rerank", 6).alias("max_rerank"), "low_confidence")


def body_quota(spark, sf_dir):
    v = _vector_half(spark, sf_dir)
    return vectors.body_quota(v.withColumn("body", F.col("id") % 3 == 0), 5, "body", [F.col("rank")]).select("id", "rank")


def _turns(spark, sf_dir, text: bool = False):
    """Turns of a conversation as consecutive spans of one text."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"), *(["text"] if text else []))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return c.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.col("n"))


SECTION = 500


def span_lookup(spark, sf_dir):
    """Every hundredth character of every conversation, to its end and one past it, with the turn that holds it."""
    turns = _turns(spark, sf_dir)
    points = turns.groupBy("conv_id").agg(F.max("char_end").alias("n")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 100, F.lit(100).cast("long"))).alias("at"))
    return spans.holding(points, turns.select("conv_id", "turn", "char_start", "char_end"), "conv_id", "at").select("conv_id", "at", "turn")


def _sections(turns):
    """Consecutive sections of a conversation up to its end, the last one short."""
    ends = turns.groupBy("conv_id").agg(F.max("char_end").alias("n")).where("n > 0")
    s = ends.select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SECTION).cast("long"))).alias("char_start"))
    return s.select("conv_id", F.concat_ws("-", "conv_id", "char_start").alias("section"), "char_start", F.least(F.col("char_start") + SECTION, "n").alias("char_end"))


def section_majority(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return spans.majority_kind(_sections(turns), turns.select("conv_id", "char_start", "char_end", F.col("role").alias("kind")), "conv_id", "section")


def section_path(spark, sf_dir):
    """The titles above the middle of every turn: its conversation's section and, one level down, its turn."""
    turns = _turns(spark, sf_dir)
    outer = _sections(turns).select("conv_id", F.lit(1).alias("level"), F.col("section").alias("title"), "char_start", "char_end")
    inner = turns.select("conv_id", F.lit(2).alias("level"), F.concat_ws(" ", "role", "turn").alias("title"), "char_start", "char_end")
    points = turns.where("n > 0").select("conv_id", "turn", ((F.col("char_start") + F.col("char_end")) / 2).cast("long").alias("at"))
    return spans.section_paths(points, outer.unionByName(inner), "conv_id", "at", ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("path", " > ").alias("path"))


def section_end(spark, sf_dir):
    """Turns as headings, users' one level above all others: where each one's section ends."""
    turns = _turns(spark, sf_dir)
    total = turns.groupBy("conv_id").agg(F.max("char_end").alias("total"))
    heads = turns.where("n > 0").select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(2).alias("level"), "char_start").join(total, "conv_id")
    return spans.section_ends(heads, "conv_id", "total").select("conv_id", "turn", "char_end")


def page_numbers(spark, sf_dir):
    """Turns as passages whose line ends stand for page breaks; every ninth conversation lacks its second turn, so later pages are unknown."""
    turns = _turns(spark, sf_dir, text=True).withColumn("text", F.translate("text", "\n", "\f"))
    there = (F.col("n") > 0) & ~((F.col("conv_id") % 9 == 0) & (F.col("turn") == 1))
    return spans.pages(turns.where(there), "conv_id", "char_start", "text").select("conv_id", "turn", "page")


def opened_passage(spark, sf_dir):
    """The last turn that begins at or before every 700th character, at most 400 back."""
    turns = _turns(spark, sf_dir)
    points = turns.groupBy("conv_id").agg(F.max("char_end").alias("n")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"), F.lit(700).cast("long"))).alias("at"))
    return spans.last_before(points, turns, "conv_id", "at", "char_start", 400)


def reranked(spark, sf_dir):
    """The vector half after a stand-in scorer, with second passages, tiers and a small budget."""
    v = _vector_half(spark, sf_dir)
    tier = F.when(F.col("id") % 7 == 0, "strong").when(F.col("id") % 5 == 0, "weak").otherwise("body")
    pool = v.select("id", (F.lit(1.0) / (60 + F.col("rank"))).alias("fused"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 3 == 0, (F.col("id") + 1).cast("string")).alias("alt_text"), tier.alias("tier"))
    out = fusion.reranked(pool, lambda q, ps: [(int(p) * 37 % 101) / 25 - 2 for p in ps], "q", 30, ["id"], limit=25)
    return out.select("id", F.round("rerank", 6).alias("rerank"), "used_alt", "place")


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_allow, best_per_label, term_stats, bm25_search, bm25_columns, bm25_allowed, best_passage, keyword_plan_prune, match_build, rrf_fuse, hybrid_search, admit_prefix, confidence, body_quota,
    span_lookup, section_majority, section_path, section_end, page_numbers, opened_passage, reranked,
)}

_SCORED = """scored AS (SELECT e.vec_id, e.label, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score
 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""
_TERMS = "('tion','the','and','hand','thing')"
_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}\p{{M}}_+#.\-]+')"
_COLUMNS = f"""cols AS (SELECT doc_id, {_TOKENS.format('text')} AS b, {_TOKENS.format("concat_ws(' ', source, lang)")} AS m FROM documents),
 toks AS (SELECT doc_id, 'body' AS col, unnest(b) AS term FROM cols UNION ALL SELECT doc_id, 'book_meta', unnest(m) FROM cols),
 post AS (SELECT doc_id, col, term, count(*) AS tf FROM toks GROUP BY ALL), lens AS (SELECT doc_id, len(b) + len(m) AS n FROM cols),
 tot AS (SELECT count(*) AS t, avg(n) AS m FROM lens)"""


def _bm25_sql(hits: str) -> str:
    """Scores bm of the postings that a condition chooses."""
    return f"""{_COLUMNS}, hits AS (SELECT doc_id, term, sum(tf * CASE WHEN col = 'body' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS f FROM post WHERE {hits} GROUP BY ALL),
 dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
 bm AS (SELECT doc_id, round(-sum(CASE WHEN ln((t - df + 0.5) / (df + 0.5)) > 0 THEN ln((t - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / m))), 9) AS score
  FROM hits JOIN dfs USING (term) JOIN lens USING (doc_id), tot GROUP BY doc_id)"""


_BM25 = _bm25_sql(f"term IN {_TERMS}")
_HALVES = f"""WITH {_SCORED}, {_BM25},
 v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT vec_id AS id, score FROM scored ORDER BY score DESC, vec_id LIMIT 50)),
 k AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM (SELECT doc_id AS id, score FROM bm ORDER BY score, doc_id LIMIT 50)),
 fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM (SELECT id, rank FROM v UNION ALL SELECT id, rank FROM k) GROUP BY id)"""
_SECTIONS = "sec AS (SELECT conv_id, conv_id || '-' || a AS section, a, least(a + 500, n) AS e FROM (SELECT conv_id, CAST(max(char_end) AS BIGINT) AS n, unnest(range(0, CAST(max(char_end) AS BIGINT), 500)) AS a FROM turns GROUP BY conv_id HAVING max(char_end) > 0))"
_TURNS = "turns AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS char_end FROM conversations)"

ORACLE_SQL = {
    "vector_topk": f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, label, vec_id LIMIT 10",
    "vector_topk_allow": f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM scored WHERE label IN (1, 3, 5) ORDER BY scored.score DESC, label, vec_id LIMIT 10",
    "best_per_label": f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id % 2, score DESC, vec_id) AS n FROM scored) SELECT label, vec_id, round(score, 6) AS score FROM r WHERE n = 1",
    "term_stats": f"WITH {_COLUMNS} SELECT col, term, count(*) AS df FROM post GROUP BY col, term",
    "bm25_columns": "WITH " + _bm25_sql("term IN ('and', 'node.js') OR (term = 'en' AND col = 'book_meta') OR (term = 'the' AND col = 'body')") + " SELECT doc_id, round(score, 6) AS score FROM bm",
    "bm25_allowed": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY bm.score, doc_id LIMIT 10",
    "best_passage": f"""WITH {_BM25}, pool AS (SELECT source AS book_id, doc_id, score, doc_id % 2 = 0 AS body FROM bm JOIN documents USING (doc_id) WHERE source IS NOT NULL ORDER BY score, source, doc_id LIMIT 400),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY body DESC, score, doc_id) AS k FROM pool) WHERE k = 1),
 quota AS (SELECT *, coalesce(sum(CAST(body AS INT)) OVER (ORDER BY score, book_id, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM best)
 SELECT book_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY quota.score, book_id, doc_id) AS INT) AS rank FROM quota WHERE seen < 20""",
    "match_build": f"""WITH {_COLUMNS}, m AS (SELECT * FROM (VALUES ('running dogs', 0, 'run'), ('running dogs', 1, 'dog'), ('c++ and node.js.', 0, 'c'), ('c++ and node.js.', 1, 'and'), ('c++ and node.js.', 2, 'node'), ('c++ and node.js.', 3, 'js'), ('c++ and node.js.', 4, 'c++'), ('c++ and node.js.', 5, 'c++.'), ('c++ and node.js.', 6, 'node.js'), ('c++ and node.js.', 7, 'node.js.'), ('книги ёлка', 0, 'книг'), ('книги ёлка', 1, 'елк'), ('api_v2 camelCase', 0, 'api_v2'), ('api_v2 camelCase', 1, 'camelcase'), ('"the end" of it', 0, 'the'), ('"the end" of it', 1, 'end'), ('"the end" of it', 2, 'of'), ('"the end" of it', 3, 'it'), ('la de que', 0, 'la'), ('la de que', 1, 'de'), ('la de que', 2, 'que')) AS m(query, place, term)), h AS (SELECT term, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS places FROM post GROUP BY term)
 SELECT query, place, term, coalesce(df, 0) AS df, coalesce(places, 0) AS places FROM m LEFT JOIN h USING (term)""",
    "bm25_search": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score, doc_id LIMIT 10",
    "keyword_plan_prune": f"WITH {_COLUMNS}, d AS (SELECT q.term, count(post.doc_id) AS df FROM (VALUES ('tion'),('the'),('and'),('hand'),('thing')) q(term) LEFT JOIN post ON post.term = q.term AND post.col = 'body' GROUP BY q.term) SELECT term, df, df <= 0.5 * (SELECT count(*) FROM documents) AS kept FROM d",
    "rrf_fuse": f"{_HALVES} SELECT id, round(fused, 8) AS fused FROM fused",
    "hybrid_search": f"{_HALVES} SELECT id, v.rank AS vector_rank, k.rank AS keyword_rank, CASE WHEN v.rank IS NULL THEN 'keyword' WHEN k.rank IS NULL THEN 'vector' ELSE 'both' END AS found_by, round(fused, 8) AS fused FROM fused LEFT JOIN v USING (id) LEFT JOIN k USING (id) ORDER BY fused.fused DESC, id LIMIT 20",
    "admit_prefix": f"{_HALVES} SELECT id, rank FROM (SELECT id, rank, sum(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END) OVER (ORDER BY rank) AS used FROM v) WHERE used <= 30",
    "confidence": f"{_HALVES}, m AS (SELECT coalesce(max(CASE WHEN id % 2 = 0 THEN score END), max(score)) AS c, coalesce(max(CASE WHEN id % 2 = 0 THEN 1.0::DOUBLE / (1 + rank) END), max(1.0::DOUBLE / (1 + rank))) AS r FROM v) SELECT round(c, 6) AS max_cosine, round(r, 6) AS max_rerank, (r < 0.3 OR c < 0.78) AS low_confidence FROM m",
    "body_quota": f"{_HALVES} SELECT id, rank FROM (SELECT id, rank, coalesce(sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM v) WHERE seen < 5",
    "span_lookup": f"WITH {_TURNS}, p AS (SELECT conv_id, unnest(range(0, CAST(max(char_end) AS BIGINT) + 101, 100)) AS o FROM turns GROUP BY conv_id) SELECT p.conv_id, CAST(p.o AS BIGINT) AS \"at\", t.turn FROM p LEFT JOIN turns t ON t.conv_id = p.conv_id AND p.o >= t.char_end - t.n AND p.o < t.char_end",
    "section_majority": f"WITH {_TURNS}, {_SECTIONS}, c AS (SELECT s.section, t.role, sum(least(t.char_end, s.e) - greatest(t.char_end - t.n, s.a)) AS covered, min(t.char_end - t.n) AS f FROM sec s JOIN turns t ON t.conv_id = s.conv_id AND t.char_end - t.n < s.e AND t.char_end > s.a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY covered DESC, f) AS k FROM c) SELECT section, coalesce(role, 'body') AS kind FROM r WHERE k = 1",
    "section_path": f"WITH {_TURNS}, {_SECTIONS}, p AS (SELECT conv_id, turn, role, CAST(floor((2 * char_end - n) / 2) AS BIGINT) AS o FROM turns WHERE n > 0) SELECT p.conv_id, p.turn, s.section || ' > ' || concat_ws(' ', p.role, p.turn) AS path FROM p JOIN sec s ON s.conv_id = p.conv_id AND p.o >= s.a AND p.o < s.e",
    "section_end": f"WITH {_TURNS}, h AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS level, char_end - n AS a, max(char_end) OVER (PARTITION BY conv_id) AS total FROM turns WHERE n > 0) SELECT x.conv_id, x.turn, CAST(coalesce(min(y.a), min(x.total)) AS BIGINT) AS char_end FROM h x LEFT JOIN h y ON y.conv_id = x.conv_id AND y.a > x.a AND y.level <= x.level GROUP BY 1, 2",
    "page_numbers": """WITH a AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
 t AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS b FROM a WHERE length(text) > 0 AND NOT (conv_id % 9 = 0 AND turn = 1)),
 u AS (SELECT *, coalesce(sum(b) OVER w, 0) AS before, coalesce(sum(length(text)) OVER w, 0) AS covered, sum(b) OVER (PARTITION BY conv_id) AS every FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT conv_id, turn, CAST(CASE WHEN covered = s AND every > 0 THEN before + 1 END AS BIGINT) AS page FROM u""",
    "opened_passage": f"WITH {_TURNS}, p AS (SELECT conv_id, unnest(range(0, CAST(max(char_end) AS BIGINT) + 1, 700)) AS o FROM turns GROUP BY conv_id) SELECT p.conv_id, CAST(p.o AS BIGINT) AS \"at\", CAST(max(t.char_end - t.n) AS BIGINT) AS opened FROM p LEFT JOIN turns t ON t.conv_id = p.conv_id AND t.char_end - t.n <= p.o AND p.o - (t.char_end - t.n) <= 400 GROUP BY 1, 2",
    "reranked": f"""{_HALVES}, p AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS fused, CASE WHEN id % 7 = 0 THEN 'strong' WHEN id % 5 = 0 THEN 'weak' ELSE 'body' END AS tier, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS pairs FROM v),
 u AS (SELECT *, sum(CASE WHEN tier = 'strong' THEN 0 ELSE pairs END) OVER (ORDER BY fused DESC, id ROWS UNBOUNDED PRECEDING) <= 25 AND tier <> 'strong' AS inside FROM p),
 s AS (SELECT *, CASE WHEN inside THEN 1 / (1 + exp(-((id * 37 % 101) / 25.0::DOUBLE - 2))) END AS main, CASE WHEN inside AND id % 3 = 0 THEN 1 / (1 + exp(-(((id + 1) * 37 % 101) / 25.0::DOUBLE - 2))) END AS alt FROM u),
 o AS (SELECT *, coalesce(alt > main, false) AS used_alt, CASE WHEN coalesce(alt > main, false) THEN alt ELSE main END AS rerank, CASE tier WHEN 'strong' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS band FROM s),
 n AS (SELECT *, row_number() OVER (ORDER BY band, inside DESC, rerank DESC NULLS LAST, CASE WHEN inside THEN id END NULLS FIRST, fused DESC, id) AS place FROM o)
 SELECT id, round(rerank, 6) AS rerank, used_alt, CAST(place AS INT) AS place FROM n WHERE place <= 30""",
}

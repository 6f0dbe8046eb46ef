"""Queries of retrieval: benchmark items as queries over documents, vectors over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import postings as P
from ..operators import retrieve as R
from ..operators.evaluate import recall
from ..sources import lexical
from ..shared import shared_folder, spread
from .common import query, table
from .corpus import KEPT

_Q = f"q AS (SELECT item_id AS query, unnest(t) AS token, unnest(range(len(t))) AS qi FROM (SELECT item_id, {KEPT.format('text')} AS t FROM benchmark))"
_HITS = (
    f"WITH l AS (SELECT doc_id AS doc, {KEPT.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM l), {_Q},"
    " r AS (SELECT doc, len(t) AS dl, unnest(t) AS token, unnest(range(len(t))) AS pos FROM l),"
    " p AS (SELECT token, doc, any_value(dl) AS dl, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM r WHERE token IN (SELECT token FROM q) GROUP BY token, doc),"
    " d AS (SELECT token, count(*) AS df FROM p GROUP BY token),"
    " h AS (SELECT q.query, q.qi, q.token, p.doc, p.tf, p.positions, p.dl, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, avgdl FROM q"
        " JOIN p ON p.token = q.token JOIN d ON d.token = q.token, st),"
    " s AS (SELECT query, doc, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, min(qi) AS first_qi FROM h GROUP BY query, doc)"
)
_TOP = ", b AS (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, first_qi, doc) AS rank FROM s)"


def _asked(spark, d):
    return R.query_tokens(table(spark, d, "benchmark"), "item_id", "text")


def _hits(spark, d, positions=True):
    return R.matched(table(spark, d, "documents"), "doc_id", "text", _asked(spark, d), positions)


def _ranked(scored, k):
    return R.top_k(scored.withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.asc("first_qi"), F.asc("doc")])


def _bm25(spark, d, k):
    """The k best of every item, by block postings and bounds."""
    q = _asked(spark, d)
    return P.search(P.blocks(table(spark, d, "documents"), "doc_id", "text", q, positions=False), q, k)


@query(_HITS + _TOP + " SELECT query, doc, score, rank FROM b WHERE rank <= 10")
def bm25_topk(spark, d):
    """R-12, A-21..23, J-04, T-01: the ten best documents of every benchmark item."""
    return _bm25(spark, d, 10).select("query", "doc", "score", "rank")


@query(
    f"WITH l AS (SELECT doc_id AS doc, {KEPT.format('text')} AS t FROM documents), r AS (SELECT doc, unnest(t) AS token, unnest(range(len(t))) AS pos FROM l),"
    " p AS (SELECT token, doc, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM r GROUP BY token, doc)"
    " SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(ln(((SELECT count(*)"
        " FROM l) - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf, max(last_pos) AS last_pos, min(first_pos) AS first_pos FROM p"
        " GROUP BY token"
)
def postings_stats(spark, d):
    """A-21, A-22: document frequency, IDF and extreme positions of every token."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    each = spread(docs.select("text")).select(T.tokens(F.col("text")).alias("t"))
    # places once each, documents once a token: partial sums by token before the only shuffle
    place = F.transform("t", lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    once = F.transform(F.array_distinct("t"), lambda t: F.struct(t.alias("token"), F.lit(None).cast("int").alias("pos")))
    rows = each.select(F.explode_outer(F.concat(place, once)).alias("r")).where("r is not null").select("r.*")
    df, at = F.count_if(F.col("pos").isNull()), F.col("pos").cast("bigint")
    out = rows.groupBy("token").agg(df.alias("df"), F.count("pos").alias("cf"), F.max(at).alias("last_pos"), F.min(at).alias("first_pos"))
    return out.select("token", "df", "cf", F.round(R.idf(n, F.col("df")), 9).alias("idf"), "last_pos", "first_pos")


_NEAR = (
    ", pr AS (SELECT x.query, x.doc, x.qi AS a, y.qi AS b, x.idf + y.idf AS w, x.positions AS p, y.positions AS o FROM h x"
        " JOIN h y ON x.query = y.query AND x.doc = y.doc AND x.qi < y.qi),"
    " m AS (SELECT query, doc, a, b, any_value(w) AS w, min(gap) AS gap FROM (SELECT query, doc, a, b, w, CASE WHEN s <> lag(s) OVER z THEN v - lag(v) OVER z END AS gap"
    " FROM (SELECT query, doc, a, b, w, unnest(p) AS v, 0 AS s FROM pr UNION ALL SELECT query, doc, a, b, w, unnest(o), 1"
        " FROM pr) WINDOW z AS (PARTITION BY query, doc, a, b ORDER BY v, s)) GROUP BY query, doc, a, b),"
    " bo AS (SELECT query, doc, sum(0.25 * w / (1 + gap)) AS bonus FROM m WHERE gap <= 10 GROUP BY query, doc),"
    " t AS (SELECT s.query, s.doc, round(s.score + coalesce(bonus, 0), 6) AS score, first_qi FROM s LEFT JOIN bo ON bo.query = s.query AND bo.doc = s.doc),"
    " pb AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, first_qi, doc) AS rank FROM t)"
)


@query(_HITS + _NEAR + " SELECT query, doc, score, rank FROM pb WHERE rank <= 10")
def bm25_proximity(spark, d):
    """J-05, M-02, M-03: BM25 with the bonus for near query tokens."""
    return R.near_top_k(_hits(spark, d), 10).select("query", "doc", "score", "rank")


@query(_HITS + _NEAR + " SELECT query, doc, score, rank FROM pb WHERE rank <= 5")
def lexical_index(spark, d):
    """S-09, R-13: an index of two thirds of the documents is saved, the others are appended, and it is loaded and searched."""
    docs, path = table(spark, d, "documents").select("doc_id", "text", "lang"), shared_folder(spark, "lexical")
    lexical.append(lexical.save(docs.where("doc_id % 3 <> 0"), "doc_id", "text", path), docs.where("doc_id % 3 = 0"), "doc_id", "text")
    return lexical.load(spark, path).search(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"))


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = f"v AS (SELECT a.vec_id AS query, b.vec_id AS vec, b.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 {{}})"


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"),
        F.col("label").alias("q_label")), v.select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v"), "label")


@query("WITH " + _DENSE.format("") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec) AS rank FROM v)"
    " SELECT query, vec, label, score, rank FROM r WHERE rank <= 10")
def dense_topk(spark, d):
    """R-14, J-06, M-01: exact nearest vectors of every fiftieth."""
    q, v = _vectors(spark, d)
    return R.dense(q, v, 10).join(v.select("vec", "label"), "vec").select("query", "vec", "label", "score", "rank")


@query("WITH " + _DENSE.format("AND a.label = b.label") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec) AS rank"
    " FROM v) SELECT query, vec, label, score, rank FROM r WHERE rank <= 10")
def dense_topk_category(spark, d):
    """F-09, O-2: the same within the query's label; the filter is below the top k."""
    return R.dense(*_vectors(spark, d), 10, "label").select("query", "vec", "label", "score", "rank")


_LISTS = (
    _HITS + _TOP + ", c AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, doc) AS rank FROM h GROUP BY query, doc),"
    " li AS (SELECT query, 0 AS list_id, rank, doc FROM b WHERE rank <= 20 UNION ALL SELECT query, 1, rank, doc FROM c WHERE rank <= 20)"
)


def _lists(spark, d):
    hits = _hits(spark, d, positions=False)
    one = _ranked(R.bm25(hits), 20).select("query", F.lit(0).alias("list_id"), "rank", F.col("doc").alias("key"))
    counted = hits.groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"))
    two = R.top_k(counted, 20, [F.desc("n"), F.asc("doc")]).select("query", F.lit(1).alias("list_id"), "rank", F.col("doc").alias("key"))
    return one.unionByName(two)


_FUSED = ", f AS (SELECT query, doc AS key, round(sum({w} / (60 + rank)), 9) AS score, min(list_id * 1000 + rank) AS first FROM li GROUP BY query, doc), x AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, first) AS rank FROM f)"


@query(_LISTS + _FUSED.format(w="1.0") + " SELECT query, key, score, rank FROM x WHERE rank <= 10")
def rrf_fuse(spark, d):
    """R-15, J-07, A-24, T-03: two lexical rankings fused."""
    return R.fuse(_lists(spark, d), 10)


@query(_LISTS + _FUSED.format(w="CASE WHEN list_id = 0 THEN 2.0 ELSE 0.5 END") + " SELECT query, key, score, rank FROM x WHERE rank <= 10")
def rrf_weighted(spark, d):
    """R-15 with weights."""
    return R.fuse(_lists(spark, d), 10, weights=spark.createDataFrame([(0, 2.0), (1, 0.5)], "list_id int, weight double"))


@query(
    _HITS + _TOP + ", z AS (SELECT b.*, d.source, row_number() OVER (PARTITION BY query, source ORDER BY rank) > 1 AS again FROM b"
        " JOIN documents d ON d.doc_id = b.doc WHERE rank <= 20),"
    " y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY again, rank) AS place FROM z) SELECT query, doc, source, score, place AS rank FROM y WHERE place <= 5"
)
def diversify_topk(spark, d):
    """R-17, W-03: five of twenty, each source's best first."""
    pool = _bm25(spark, d, 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return R.diversify(pool, 5).select("query", "doc", "source", "score", "rank")


@query(
    _HITS + _TOP + f", z AS (SELECT b.query, b.doc, b.rank, list_distinct({KEPT.format('i.text')}) AS qt, {KEPT.format('d.text')} AS dt FROM b"
        f" JOIN documents d ON d.doc_id = b.doc JOIN benchmark i ON i.item_id = b.query WHERE b.rank <= 20),"
    " o AS (SELECT query, doc, rank, CASE WHEN len(qt) > 0 THEN round(len(list_intersect(qt, dt)) / len(qt), 9) ELSE 0.0 END AS score FROM z),"
    " y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM o) SELECT query, doc, score, place AS rank FROM y WHERE place <= 5"
)
def rerank_topk(spark, d):
    """R-16, T-04: twenty reranked by a scorer (token overlap stands in), ties in the pool's order."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    pool = _bm25(spark, d, 20).join(texts, "doc").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q_text")), "query")
    return R.rerank(pool, F.round(R.overlap_score(F.col("q_text"), F.col("text")), 9), 5).select("query", "doc", "score", "rank")


_GOLD = ", gold AS (SELECT i.item_id AS query, min(d.doc_id) AS gold FROM benchmark i JOIN documents d ON contains(d.text, i.text) GROUP BY i.item_id), fd AS (SELECT g.query, b.rank AS found_at FROM gold g LEFT JOIN b ON b.query = g.query AND b.doc = g.gold AND b.rank <= 20)"


def _gold(spark, d, own=None):
    return R.containing(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", own)


def _ranked_and_gold(spark, d):
    """The 20 best documents of every item, and the first that contains it, from the same postings."""
    q = _asked(spark, d)
    own = P.blocks(table(spark, d, "documents"), "doc_id", "text", q, positions=False)
    return P.search(own, q, 20), _gold(spark, d, own)


def _title(column):
    return F.col(column).cast("string")


_REC = "round(avg(CASE WHEN found_at <= {k} THEN 1.0 ELSE 0.0 END), 9) AS recall_{k}"
_RECALLS = "count(*) AS n, " + ", ".join(_REC.format(k=k) for k in (1, 3, 5, 10)) + ", round_even(avg(coalesce(1.0 / found_at, 0)), 4) AS mrr"


@query(_HITS + _TOP + _GOLD + f" SELECT {_RECALLS} FROM fd")
def retrieval_recall(spark, d):
    """R-35, A-13, A-14, W-04: recall at k and MRR of the documents that contain an item."""
    ranked, gold = _ranked_and_gold(spark, d)
    return recall(R.title_rank(ranked.select("query", _title("doc").alias("title"), "rank"), gold.select("query", _title("gold").alias("gold"))), (1, 3, 5, 10), [])


@query(_HITS + _TOP + _GOLD + f" SELECT lang AS category, {_RECALLS} FROM fd JOIN gold USING (query) JOIN documents d ON d.doc_id = gold.gold GROUP BY lang")
def recall_by_category(spark, d):
    """A-13 by the gold document's language."""
    ranked, gold = _ranked_and_gold(spark, d)
    found = R.title_rank(ranked.select("query", _title("doc").alias("title"), "rank"), gold.select("query", _title("gold").alias("gold")))
    lang = gold.join(table(spark, d, "documents").select(F.col("doc_id").alias("gold"), F.col("lang").alias("category")), "gold").select("query", "category")
    return recall(found.join(lang, "query"), (1, 3, 5, 10), ["category"])


@query(
    _HITS + _TOP + _GOLD + ", sr AS (SELECT b.query, b.rank, d.source FROM b JOIN documents d ON d.doc_id = b.doc WHERE b.rank <= 20)"
        ", gs AS (SELECT g.query, d.source FROM gold g JOIN documents d ON d.doc_id = g.gold),"
    " c AS (SELECT gs.query, min(sr.rank) AS found_at FROM gs LEFT JOIN sr ON sr.query = gs.query AND sr.source = gs.source GROUP BY gs.query)"
    " SELECT count(*) AS n, round(avg(CASE WHEN found_at <= 3 THEN 1.0 ELSE 0.0 END), 9) AS recall_3, round_even(avg(coalesce(1.0 / found_at, 0)), 4) AS mrr FROM c"
)
def recall_chunk_rank(spark, d):
    """A-15: by raw passage rank, sources not deduplicated."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    ranked, gold = _ranked_and_gold(spark, d)
    ranked = ranked.join(docs, "doc").select("query", "rank", "source")
    gold = gold.join(docs.withColumnRenamed("doc", "gold"), "gold").select(F.col("query").alias("g"), F.col("source").alias("g_source"))
    found = gold.join(ranked, (F.col("g") == F.col("query")) & (F.col("source") == F.col("g_source")), "left").groupBy("g").agg(F.min("rank").alias("found_at"))
    return recall(found, (3,), [])


@query(
    _HITS + _TOP + ", z AS (SELECT b.query, b.doc, b.rank, length('[' || rank || '] ' || source || chr(10) || left(text, 800)) AS n FROM b"
        " JOIN documents d ON d.doc_id = b.doc WHERE rank <= 10),"
    " y AS (SELECT *, sum(n) OVER (PARTITION BY query ORDER BY rank) AS used FROM z) SELECT query, doc, rank, CAST(used AS BIGINT) AS used FROM y WHERE used <= 2400"
)
def context_budget(spark, d):
    """W-13, X-08: passages until the first that would exceed 2,400 characters; each has at most 800 of its text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.substring("text", 1, 800).alias("head"))
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit("\n"), "head")
    return R.context_budget(_bm25(spark, d, 10).join(docs, "doc").withColumn("entry", entry), 2400).select("query", "doc", "rank", "used")


@query("SELECT item_id AS question_id, i AS list_id, CASE WHEN i = 0 THEN text ELSE text || ' ' || ['alpha', 'beta'][i] END AS text FROM benchmark, (VALUES (0), (1), (2)) AS t(i)")
def multi_query_fanout(spark, d):
    """J-19: the question alone and with each option."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.array(F.lit("alpha"), F.lit("beta")).alias("options"))
    return R.multi_query(q)

"""Retrieval: postings, BM25, dense search, fusion, diversification, reranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..shared import cut, small
from .dense import search as dense  # noqa: F401
from .postings import K1, B, Blocks, blocks, hits, idf  # noqa: F401

ALPHA, REACH = 0.25, 10


def query_tokens(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, qi, token): repeated tokens stay."""
    return queries.select(F.col(query).alias("query"), F.posexplode(T.tokens(F.col(text))).alias("qi", "token"))


def matched(docs: DataFrame, doc: str, text: str, q: DataFrame, positions: bool = True) -> DataFrame:
    """(query, qi, token, doc, tf, positions, dl, idf, avgdl) of the documents' tokens that occur in a query of q (query, qi, token), however
    many there are; from block postings of just those tokens.
    """
    return hits(blocks(docs, doc, text, q, positions=positions), q)


def bm25(hits: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score, first_qi); a token that a query repeats counts each time."""
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("score"), F.min("qi").alias("first_qi"))


def proximity(hits: DataFrame, alpha: float = ALPHA, reach: int = REACH) -> DataFrame:
    """(query, doc, bonus): for each two query tokens in a document within reach, alpha (idf a + idf b) / (1 + gap).

    The places of a document's hits are sorted once, so each is only compared
    with the few that follow within reach, and of two tokens the least gap counts.
    """
    member = F.struct("qi", "idf", "token", "positions")
    grouped = hits.groupBy("query", "doc").agg(F.array_sort(F.collect_list(member)).alias("h")).where(F.size("h") > 1)
    places = F.sort_array(F.flatten(F.transform("h", lambda x, i: F.transform(x["positions"], lambda p: F.struct(p.alias("p"), i.alias("i"))))))
    # a place holds one token, but a query may repeat it
    most = (reach + 1) * (1 + F.size("h") - F.size(F.array_distinct(F.transform("h", lambda x: x["token"]))))

    def pairs(placed: Column, most: Column) -> Column:
        def after(x: Column, j: Column) -> Column:
            near = F.filter(F.slice(placed, j + 2, most), lambda y: (y["p"] - x["p"] <= reach) & (y["i"] != x["i"]))
            return F.transform(near, lambda y: F.struct(F.least(x["i"], y["i"]).alias("a"), F.greatest(x["i"], y["i"]).alias("b"), (y["p"] - x["p"]).alias("gap")))

        return F.sort_array(F.flatten(F.transform(placed, after)))

    def of(near: Column) -> Column:
        """Of the sorted pairs the first of each two tokens has the least gap."""
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])
        first = F.filter(near, lambda x, j: (j == 0) | ~same(x, F.get(near, j - 1)))
        weight = lambda x: (F.get("h", x["a"])["idf"] + F.get("h", x["b"])["idf"]) / (1 + x["gap"])
        return F.aggregate(first, F.lit(0.0), lambda s, x: s + F.lit(alpha) * weight(x))

    bonus = N.let(N.let(most, lambda m: N.let(places, lambda placed: pairs(placed, m))), of)
    return grouped.select("query", "doc", bonus.alias("bonus"))


def near_top_k(hits: DataFrame, k: int, k1: float = K1, b: float = B, alpha: float = ALPHA, reach: int = REACH) -> DataFrame:
    """(query, doc, score, first_qi, rank): the k best by BM25 and the bonus for near tokens, rounded to 6 places, ties by first_qi, then doc.

    A bonus is at most alpha times each pair's weights, so places are only looked
    at in documents that can reach the k-th best score without any bonus.
    """
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    plain = hits.groupBy("query", "doc").agg(F.sum(part).alias("score"), F.min("qi").alias("first_qi"), ((F.count("qi") - 1) * F.sum("idf")).alias("pairs"))
    plain = cut(plain)
    least = top_k(plain, k, [F.desc("score")]).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    open_ = plain.join(least, "query", "left").where(F.col("least").isNull() | (F.col("score") + alpha * F.col("pairs") >= F.col("least") - 2e-6)).drop("least", "pairs")
    bonus = proximity(hits.join(open_.select("query", "doc"), ["query", "doc"], "left_semi"), alpha, reach)
    scored = open_.join(bonus, ["query", "doc"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 6)).drop("bonus")
    return top_k(scored, k, [F.desc("score"), F.asc("first_qi"), F.asc("doc")])


def top_k(scored: DataFrame, k: int, order: list[Column], by: str | list[str] = "query") -> DataFrame:
    """The first k rows of each group and their rank; Spark keeps only k rows of a group before the shuffle."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def fuse(lists: DataFrame, k: int, rrf_k: int = 60, weights: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (query, list_id, rank, key): (query, key, score, rank).  A list of weight 0 adds no keys, one without a weight is an error."""
    if weights is not None:
        said = F.concat(F.lit("no weight for list "), F.col("list_id").cast("string"))
        lists = lists.join(F.broadcast(weights), "list_id", "left").withColumn("weight", F.coalesce("weight", F.raise_error(said).cast("double"))).where("weight > 0")
    w = F.col("weight") if weights is not None else F.lit(1.0)
    fused = lists.groupBy("query", "key").agg(F.sum(w / (rrf_k + F.col("rank"))).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    return top_k(fused.withColumn("score", F.round("score", 9)), k, [F.desc("score"), F.asc("first")]).drop("first")


def diversify(ranked: DataFrame, k: int, source: str = "source") -> DataFrame:
    """The k first of (query, rank, source), each source's best before any second of a source."""
    w = Window.partitionBy("query", source).orderBy("rank")
    return top_k(ranked.withColumn("_again", (F.row_number().over(w) > 1).cast("int")).withColumnRenamed("rank", "pool_rank"), k,
        [F.asc("_again"), F.asc("pool_rank")]).drop("_again")


def overlap_score(query: Column, text: Column) -> Column:
    """A reranker's stand-in: the share of the query's distinct tokens that the text has."""
    q, t = F.array_distinct(T.tokens(query)), T.tokens(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


_models: dict[str, object] = {}


def _loaded(key: str, load: Callable) -> object:
    """A worker's model, loaded when it is first asked for."""
    if key not in _models:
        _models[key] = load()
    return _models[key]


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A model's scorer of (queries, texts) as a function of Columns: load is called once in a worker, what it returns with whole Arrow
    batches; another number of scores than of pairs is an error.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = _loaded(key, load)
        for queries, texts in batches:
            out = list(score(queries.fillna("").tolist(), texts.fillna("").tolist()))
            if len(out) != len(queries):
                raise ValueError(f"{len(out)} scores for {len(queries)} pairs")
            yield pd.Series(out, dtype="float64")

    return run


def batch_scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """model_scorer of a function that needs no loading."""
    return model_scorer(lambda: score)


def model_encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int) -> Callable[[Column], Column]:
    """A model's encoder as a function of a Column: load is called once in a worker, what it returns with whole Arrow batches; another number or length of vectors is an error."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _loaded(key, load)
        for texts in batches:
            out = [list(map(float, v)) for v in encode(texts.fillna("").tolist())]
            if len(out) != len(texts) or any(len(v) != dim for v in out):
                raise ValueError(f"the encoder must give {len(texts)} vectors of {dim} numbers")
            yield pd.Series(out)

    return run


def batch_encoder(encode: Callable[[list[str]], list[list[float]]], dim: int) -> Callable[[Column], Column]:
    """model_encoder of a function that needs no loading."""
    return model_encoder(lambda: encode, dim)


def rerank(pool: DataFrame, score: Column, k: int) -> DataFrame:
    """pool (query, rank, ...) by a new score, ties in the pool's order."""
    return top_k(pool.withColumn("score", score).withColumnRenamed("rank", "pool_rank"), k, [F.desc("score"), F.asc("pool_rank")])


def multi_query(questions: DataFrame) -> DataFrame:
    """(question_id, list_id, text): the question, and the question with each option."""
    texts = F.concat(F.array("question"), F.transform("options", lambda o: F.concat_ws(" ", "question", o)))
    return questions.select("question_id", F.posexplode(texts).alias("list_id", "text"))


#: Items without a token to be found by that go to every task at once; more take more passes.
ITEMS = 20_000


def inner_tokens(items: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item, inner): the kept tokens of each item but its first and last, which may be parts of words where a text contains it."""
    every = T.tokens(F.col(item), False)
    inner = N.let(every, lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0))))
    return items.where(F.col(item).isNotNull()).select(F.col(query).alias("query"), F.col(item).alias("item"), F.filter(inner, lambda t: ~t.isin(*T.STOPWORDS)).alias("inner"))


def containing(docs: DataFrame, doc: str, text: str, items: DataFrame, query: str, item: str, own: Blocks | None = None) -> DataFrame:
    """(query, gold): the first document that contains the item, for any number of items; a null one is in none.

    An item's inner tokens stand whole in every document that contains it, so it
    is looked for where the rarest of them is, by block postings (own, if they
    have the items' tokens already).  Items without inner tokens are looked for
    in every document, ITEMS at a time.
    """
    said = cut(inner_tokens(items, query, item))
    wanted = said.select(F.explode("inner").alias("token")).distinct()
    own = own or blocks(docs, doc, text, wanted, positions=False)
    rare = said.select("query", F.explode("inner").alias("token")).join(own.frequencies(), "token").groupBy("query").agg(F.min(F.struct("df", "token")).alias("r"))
    met = own.table.join(small(rare.select("query", F.col("r.token").alias("token"))), "token").select("query", F.inline("postings")).select("query", F.col("doc").alias("gold"))
    rows = docs.select(F.col(doc).alias("gold"), F.col(text).alias("text"))
    told = small(said.select("query", "item"))
    found = rows.join(small(met.distinct()), "gold").join(told, "query").where(F.col("text").contains(F.col("item"))).select("query", "gold")
    bare = said.where(F.size("inner") == 0).select("query", "item")
    parts = -(-bare.count() // ITEMS)
    for part in range(parts):
        some = bare.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        found = found.union(rows.join(F.broadcast(some), F.col("text").contains(F.col("item"))).select("query", "gold"))
    return found.groupBy("query").agg(F.min("gold").alias("gold"))


def title_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, found_at): rank of the gold title among the distinct titles of hits (query, rank, title); null if absent."""
    firsts = hits.groupBy("query", F.trim("title").alias("title")).agg(F.min("rank").alias("at"))
    ranked = firsts.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("at")))
    g = gold.select("query", F.trim("gold").alias("gold"))
    return g.join(ranked, (g["query"] == ranked["query"]) & (F.col("gold") == F.col("title")), "left").select(g["query"], F.col("place").alias("found_at"))


def context_budget(passages: DataFrame, most: int) -> DataFrame:
    """Passages (query, rank, entry) up to the first that would exceed most characters in all."""
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return passages.withColumn("used", F.sum(F.char_length("entry")).over(w)).where(F.col("used") <= most)

"""Block postings: BM25 for any number of queries over a corpus of any size.

Documents are dealt out to ranges by a hash.  A block holds a token's postings in
one range, so the blocks of a frequent token lie in as many tasks as there are
ranges, and blocks of different tokens are about the same documents: a query's
best score in a range is at most the sum of the highest impacts of its tokens'
blocks there.  A search scores the most promising ranges of each query first,
takes the k-th best score as a threshold, and opens only those other ranges whose
bound reaches it.  The result is that of scoring every posting.

Queries are tables: nothing of them, and no token, goes to the driver, and they
are broadcast only after they were counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut, small, spread

K1, B = 1.5, 0.75
#: Documents of a range, on average.
RANGE = 2048
#: Ranges of each query that are scored before there is a threshold.
FIRST = 2
#: Ranges up to which a search opens all blocks at once.
WHOLE = 8
#: Scores are rounded to 6 places before they are compared.
_SLACK = 2e-6
_ALL = "\0"  # no token: its postings are all documents


@dataclass
class Blocks:
    """table (token, range, postings: array<struct<doc, tf, dl, positions>>); n_docs and avgdl are those of the whole corpus."""

    table: DataFrame
    n_docs: int
    avgdl: float
    ranges: int

    def frequencies(self) -> DataFrame:
        """(token, df)."""
        return self.table.groupBy("token").agg(F.sum(F.size("postings")).alias("df"))


def tokenised(docs: DataFrame, doc: str, text: str, *keep: str) -> DataFrame:
    """(doc, dl, pos, token, and what is kept) of every token of every document, and a row of the token _ALL for the document itself; a text is tokenised once."""
    each = spread(docs.select(F.col(doc).alias("doc"), *keep, F.col(text).alias("_text"))).select("doc", *keep, T.tokens(F.col("_text")).alias("_t"))
    # the outer form, as the plain one makes the optimiser ask for the array's size first and so for the tokens twice
    out = each.select("doc", *keep, F.size("_t").alias("dl"), F.posexplode_outer(F.concat("_t", F.array(F.lit(_ALL)))).alias("pos", "token"))
    return out.where("token is not null")


def blocks(docs: DataFrame, doc: str, text: str, wanted: DataFrame | None = None, *, positions: bool = True, docs_in_range: int = RANGE) -> Blocks:
    """The corpus as blocks, of the tokens of wanted (token) only if that is given.

    One pass over the texts, and one shuffle of the wanted tokens' places.  Rows
    that repeat a doc are one document with the places of all of them and the
    length of the longest; a null text has no tokens but counts as a document.
    """
    ranges = max(1, docs.count() // docs_in_range)
    rows = tokenised(docs, doc, text)
    if wanted is not None:
        kept = wanted.select("token").union(docs.sparkSession.createDataFrame([(_ALL,)], "token string")).distinct()
        rows = rows.join(small(kept), "token", "left_semi")
    placed = rows.withColumn("range", F.pmod(F.xxhash64("doc"), F.lit(ranges))).repartition("token", "range")
    place = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    posted = placed.groupBy("token", "range", "doc").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"), *place)
    members = F.struct("doc", "tf", "dl", *(["positions"] if positions else []))
    table = cut(posted.groupBy("token", "range").agg(F.collect_list(members).alias("postings")))
    whole = table.where(F.col("token") == _ALL).select(F.size("postings").alias("n"), F.aggregate("postings", F.lit(0).cast("long"), lambda s, p: s + p["dl"]).alias("dl"))
    n_docs, total = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return Blocks(table.where(F.col("token") != _ALL), n_docs, total / n_docs if n_docs else 0.0, ranges)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def impact(tf: Column, dl: Column, avgdl: float, k1: float = K1, b: float = B) -> Column:
    """What a posting adds to a score, but for its token's IDF."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def weighed(own: Blocks, q: DataFrame) -> DataFrame:
    """(query, qi, token, idf) of q (query, qi, token) for tokens that the corpus has."""
    return q.join(own.frequencies(), "token").select("query", "qi", "token", idf(F.lit(own.n_docs), F.col("df")).alias("idf"))


def hits(own: Blocks, q: DataFrame) -> DataFrame:
    """(query, qi, token, doc, tf, positions, dl, idf, avgdl): every posting of every query's tokens.  Beyond a broadcast the join is by token, whose hot ones AQE splits."""
    found = own.table.join(small(weighed(own, q)), "token")
    return found.select("query", "qi", "token", F.inline("postings"), "idf").withColumn("avgdl", F.lit(own.avgdl))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query of scored (query, doc, score, first_qi) and their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("first_qi"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def search(own: Blocks, q: DataFrame, k: int, *, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """(query, doc, score, first_qi, rank): the k best documents of each query of q (query, qi, token), ties by the first matching token, then by document.

    A token that a query repeats counts each time.  Scores are rounded to 6
    places.  Equal to scoring all of hits(), which is what is done where there
    are too few ranges for bounds to pay.
    """
    if own.ranges <= WHOLE:
        part = F.col("idf") * impact(F.col("tf"), F.col("dl"), own.avgdl, k1, b)
        return best(hits(own, q).groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"), F.min("qi").alias("first_qi")), k)
    said = cut(weighed(own, q).groupBy("query", "token").agg(F.sum("idf").alias("weight"), F.min("qi").alias("qi")))
    highest = F.array_max(F.transform("postings", lambda p: impact(p["tf"], p["dl"], own.avgdl, k1, b)))
    tops = own.table.select("token", "range", highest.alias("top"))
    bounds = tops.join(small(said), "token").groupBy("query", "range").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    promising = Window.partitionBy("query").orderBy(F.desc("bound"), F.asc("range"))
    bounds = cut(bounds.withColumn("nth", F.row_number().over(promising)))

    def scored(chosen: DataFrame) -> DataFrame:
        opened = chosen.select("query", "range").join(said, "query")
        posted = own.table.join(small(opened), ["token", "range"]).select("query", "weight", "qi", F.inline("postings"))
        part = F.col("weight") * impact(F.col("tf"), F.col("dl"), own.avgdl, k1, b)
        return posted.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"), F.min("qi").alias("first_qi"))

    early = cut(best(scored(bounds.where(F.col("nth") <= first)), k))
    least = early.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    rest = bounds.where(F.col("nth") > first).join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK))
    return best(early.drop("rank").unionByName(scored(rest)), k)

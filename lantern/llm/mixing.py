"""Mixing sources to target weights by Poisson replication.

A source s with n_s rows and target share w_s gets the mean repetition rate
lambda_s = w_s * total / n_s.  Each document draws its number of copies by
inverting the Poisson distribution of that mean at a point that is hashed from
the seed and its id, so a run repeats exactly and needs no state.  Copies are
exploded and dealt out in the order of a second hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small

#: A larger mean is drawn as a sum of equal parts of at most this, each at a point of its own: the sum is Poisson too, and no table of the distribution grows long.
PART = 200.0
#: Sources up to which the rates and their tables (a few hundred numbers at most) are broadcast.
SOURCES = 20_000
#: 13 hex digits of an MD5 are 52 bits: every value is exact in a double.
_UNIT = float(2**52)


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns as text (null: empty)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(_UNIT)


def _thresholds(mean: Column, longest: Column) -> Column:
    """P(X <= k) for k = 0 .. longest, beyond which less than 2^-52 is left: terms e^-m m^k / k!, by logarithms, so no mean underflows."""
    start = F.struct(F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("sum"), (-mean).alias("log"))

    def step(acc, k):
        total = acc["sum"] + F.exp(acc["log"])
        return F.struct(
            F.concat(acc["cdf"], F.array(total)).alias("cdf"),
            total.alias("sum"),
            (acc["log"] + F.log(mean) - F.log(k + F.lit(1.0))).alias("log"),
        )

    return F.aggregate(F.sequence(F.lit(0), longest), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: DataFrame | None, total: int | None, source: str = "source", power: float = 0.5) -> DataFrame:
    """(source, n, rate): the mean number of copies of a document of each source.

    weights: (source, weight), normalised over the sources that have rows; None
    weighs a source by its number of rows to the given power (1: as they come,
    0: all alike).  Sources without a weight, or with one
    that is null or not positive, get rate 0.  total: rows wanted, None for as
    many as there are.  A null source is a source of its own.
    """
    key = F.col(source)
    n = docs.groupBy(key.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").cast("double").alias("weight"))
        n = n.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    n = n.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = n.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    wanted = sums.select("all_n").scalar() if total is None else F.lit(total)
    rate = F.when(F.col("weight") > 0, F.col("weight") / sums.select("all_weight").scalar() * wanted / F.col("n")).otherwise(0.0)
    return n.select("source", "n", rate.cast("double").alias("rate"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    total: int | None = None,
    *,
    power: float = 0.5,
    seed: str = "mix",
    id_col: str = "doc_id",
    source: str = "source",
    partitions: int | None = None,
) -> DataFrame:
    """docs, each row repeated by its Poisson draw, in a global pseudo-random order.

    Adds copy_no (from 0), rate and shuffle_key (clashing columns of docs are
    replaced).  Rows with equal ids draw alike; a null id draws like an empty
    one.  An empty docs gives an empty result.  Beyond SOURCES sources
    the rates are joined by a shuffle, whose hot sources AQE splits.
    """
    docs = docs.drop("copy_no", "rate", "shuffle_key")
    of, count, number, at_u, cdf = (free_name(docs, "_mix_" + x) for x in ("source", "parts", "n", "u", "cdf"))
    means = rates(docs, weights, total, source, power)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    mean = F.col("rate") / parts
    spread = F.greatest(F.lit(0), F.ceil(mean + 12 * F.sqrt(mean + 1) + 20)).cast("int")
    table = means.select(F.col("source").alias(of), "rate", parts.alias(count), F.when(F.col("rate") > 0, _thresholds(mean, spread)).alias(cdf))
    joined = docs.join(small(table, limit=SOURCES), F.col(source).eqNullSafe(F.col(of)), "inner")
    at = lambda u: F.size(F.filter(cdf, lambda p: p <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col(count) - 1), F.lit(0), lambda n, j: n + at(unit_hash(seed, F.col(id_col), j)))
    copies = F.when(F.col(cdf).isNull(), 0).otherwise(at(F.col(at_u)) + F.when(F.col(count) > 1, more).otherwise(0))
    drawn = joined.withColumn(at_u, unit_hash(seed, F.col(id_col))).withColumn(number, copies).drop(of, cdf, at_u, count)
    out = drawn.where(F.col(number) > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col(number) - 1))).drop(number)
    out = out.withColumn("shuffle_key", unit_hash(seed + "/order", F.col(id_col), F.col("copy_no")))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int"))  # the key is uniform, so nothing need be sampled to find ranges
    return dealt.sortWithinPartitions("shuffle_key")

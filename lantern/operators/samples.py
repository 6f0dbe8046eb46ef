"""Exact samples and shuffled splits, without ordering a table as a whole.

Rows are shuffled by a hash of 52 bits, drawn from a seed and a key.  Which hash
the n-th row has is found by histograms of the range that holds it, a few
thousand counts a pass; the rows before it are the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

BITS, CELLS = 52, 4096


def shuffle_hash(seed: int | str, *key: str) -> Column:
    """A number of BITS bits from the MD5 of the seed and the key's columns as text (null: empty)."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def nth(hashes: DataFrame, n: int) -> tuple[int, int]:
    """(bound, rest) for hashes (h) of more than n rows: n - rest rows have h < bound, and rest more are to come of those with h = bound."""
    low, width, ahead = 0, 1 << BITS, 0
    while width > 1:
        step = max(1, width // CELLS)
        cell = F.floor((F.col("h") - low) / F.lit(step)).cast("bigint")
        counts = dict(hashes.where((F.col("h") >= low) & (F.col("h") < low + width)).groupBy(cell.alias("c")).count().collect())  # CELLS at most
        for c in sorted(counts):
            if ahead + counts[c] > n:
                break
            ahead += counts[c]
        low, width = low + c * step, step
        if ahead == n:
            break
    return low, n - ahead


def marked(df: DataFrame, n: int, key: list[str], seed: int | str = 0, name: str = "taken") -> DataFrame:
    """df with a boolean: whether a row is among the n first of the shuffle; exactly min(n, rows) are.

    Rows of equal keys have equal hashes; of those at the bound as many are
    taken as are missing, numbered within their partitions.
    """
    shuffled = df.withColumn("_h", shuffle_hash(seed, *key))
    total = shuffled.count()
    if n >= total or n <= 0:
        return df.withColumn(name, F.lit(n > 0))
    bound, rest = nth(shuffled.select(F.col("_h").alias("h")), n)
    sure = shuffled.where(F.col("_h") != bound).withColumn(name, F.col("_h") < bound)
    ties = shuffled.where(F.col("_h") == bound)
    if rest == 0:
        return sure.unionByName(ties.withColumn(name, F.lit(False))).drop("_h")
    ties = cut(ties)  # their numbers must be those that were counted
    placed = ties.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33))
    takes, left = [], rest
    for p, count in sorted(placed.groupBy("_p").count().collect()):
        takes.append((p, min(count, left)))
        left -= takes[-1][1]
    known = F.broadcast(df.sparkSession.createDataFrame(takes, "_p long, _own long"))  # a row for each partition
    named = placed.join(known, "_p").withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) < F.col("_own"))
    return sure.unionByName(named.drop("_p", "_at", "_own")).drop("_h")


def sample(df: DataFrame, n: int, key: list[str], seed: int | str = 0) -> DataFrame:
    """n rows of df without replacement, all of them if there are no more."""
    return marked(df, n, key, seed, "_taken").where("_taken").drop("_taken")


def split(df: DataFrame, fraction: float, key: list[str], seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """A shuffled split: int(rows * fraction) rows, and the others."""
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"fraction must be in (0, 1), got {fraction}")
    both = cut(marked(df, int(df.count() * fraction), key, seed, "_taken"))
    return both.where("_taken").drop("_taken"), both.where("not _taken").drop("_taken")

"""Joins of windows with points in time, windows of any length.

A window of length l belongs to the level whose bins are l long or a bit more,
so it lies in at most two of them; a point lies in one bin of each level that
has windows.  Both meet by equality of (level, bin), and are compared exactly
then.  Bins with many points are dealt out by a salt: their points to one part
each, their windows to all parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small

#: Points of a bin that stay together.
HOT = 100_000


def _micros(t: str) -> Column:
    """Microseconds of a timestamp, with or without a time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', CAST(`{t}` AS TIMESTAMP_NTZ))")


def within(windows: DataFrame, start: str, end: str, points: DataFrame, at: str, by: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Pairs of a row of windows and a row of points with start <= at <= end (and equal by): all columns of both, but by once.

    Windows that end before they start, and nulls in start, end, at or by, meet
    nothing.  Column names other than by must differ.
    """
    by = by or []
    w = windows.withColumns({"_from": _micros(start), "_to": _micros(end)}).where("_from <= _to")
    w = w.withColumn("_level", F.ceil(F.log2((F.col("_to") - F.col("_from") + 1).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in w.select("_level").distinct().collect())  # 64 at most
    p = points.withColumn("_at", _micros(at)).where("_at is not null")
    bin_ = lambda t: F.expr(f"{t} div shiftleft(1L, _level) - CASE WHEN {t} < 0 AND {t} % shiftleft(1L, _level) <> 0 THEN 1 ELSE 0 END")
    w = w.withColumn("_bin", F.explode(F.sequence(bin_("_from"), bin_("_to"))))
    p = p.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", bin_("_at"))
    key = [*by, "_level", "_bin"]
    crowded = p.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).cast("int").alias("_parts")).where("_parts > 1")
    crowded = small(crowded)
    w = w.join(crowded, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    p = p.join(crowded, key, "left").withColumn("_salt", F.pmod(F.xxhash64("_at", *[c for c in points.columns if c not in by]), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    met = w.join(p, [*key, "_salt"]).where((F.col("_from") <= F.col("_at")) & (F.col("_at") <= F.col("_to")))
    return met.drop("_from", "_to", "_at", "_level", "_bin", "_salt")

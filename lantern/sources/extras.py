"""Log lines with fields that no schema names: kept as variants, and asked for by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str, extras: str = "extras") -> DataFrame:
    """JSON lines with the columns of schema and the object extras as a variant, whatever it holds; a line without it has a null there, one that is no JSON is left out."""
    columns = [x.split() for x in schema.split(", ")]
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("_line")).where("_line is not null")
    return rows.select(*[F.try_variant_get("_line", f"$.{name}", kind).alias(name) for name, kind in columns], F.try_variant_get("_line", f"$.{extras}", "variant").alias(extras))


def value(path: str, kind: str, extras: str = "extras") -> Column:
    """A field of the extras as a type; null where it is absent or can't be cast."""
    return F.try_variant_get(extras, path, kind)


def fields(rows: DataFrame, order: str, extras: str = "extras") -> DataFrame:
    """(key, kind, n, first): the top fields of the extras with the kinds of their values (nested objects are OBJECT, lists ARRAY), rows that have them, and the least of order."""
    each = rows.select(order, extras).where(f"{extras} is not null")
    pairs = each.lateralJoin(each.sparkSession.tvf.variant_explode(F.col(extras).outer())).select(order, "key", F.schema_of_variant("value").alias("_kind"))
    kind = F.regexp_extract("_kind", r"^[A-Z]+", 0).alias("kind")
    return pairs.where("key is not null").groupBy("key", kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))

"""Importance resampling toward a target distribution, by hashed features.

Identical texts are collapsed first, by grouping the full text: features are
computed and weighted once for a text, and what it adds to the corpus is
multiplied by its number of copies.  The weights are then joined back to the
documents, and only there does each document get a noise of its own (a Gumbel
variable that is hashed from its id), so copies compete like other documents.
The highest scores are drawn.

From pass to pass a text's features go as numbers of buckets under the SHA-256
of the text; texts are shuffled once, for the grouping, with at most one row
for each text and task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, prepare

#: A-Z become lower case and other ASCII but digits and letters a space; bytes from 128 on are parts of characters that belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Features whose bucket a task keeps at hand; beyond it they are hashed each time.
_KNOWN = 500_000
#: Buckets at most: their gains (8 bytes each) go to every task.
MOST_BUCKETS = 1 << 20


class _Buckets(dict):
    """feature -> bucket."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(self) < _KNOWN:
            self[feature] = bucket
        return bucket


def _runs(words: list[bytes], longest: int):
    """All runs of 1 to longest consecutive words, joined by one space."""
    yield from words
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def collapsed(docs: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(key, copies, n_words, n_features, buckets): a row for each different text (null: empty); buckets are packed numbers of 4 bytes, a feature each."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")

    def run(batches):
        bucket_of = _Buckets(buckets).__getitem__
        names = ["key", "copies", "n_words", "n_features", "buckets"]
        for b in batches:
            keys, words, packed = [], [], []
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                keys.append(hashlib.sha256(raw).digest())
                words.append(raw.translate(_FOLD).split())
                packed.append(np.fromiter(map(bucket_of, _runs(words[-1], longest)), np.uint32).tobytes())
                words[-1] = len(words[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), b.column(1), pa.array(words, pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], names=names)

    prepare(docs.sparkSession)
    texts = docs.groupBy(F.coalesce(F.col(text), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return texts.mapInArrow(run, "key binary, copies long, n_words long, n_features long, buckets binary")


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features in each bucket over all copies; a task sends at most a row for each bucket."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for copies, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums += copies * np.bincount(np.frombuffer(packed, np.uint32), minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], names=["bucket", "n"])

    parts = texts.select("copies", "buckets").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the target's smoothed share over the source's."""
    zero = F.lit(0).cast("long")
    both = source.select("bucket", F.col("n").alias("s"), zero.alias("t")).union(target.select("bucket", zero, F.col("n")))
    both = both.union(source.sparkSession.range(buckets).select("id", zero, zero)).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def weights(texts: DataFrame, gain: DataFrame, buckets: int) -> DataFrame:
    """(key, n_words, n_features, weight): the sum of gains over a text's features.  The gains, one for each bucket, go to all tasks."""
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():
        table[r.bucket] = r.gain
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            summed = [int(sent.value[np.frombuffer(p, np.uint32)].sum()) for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(summed, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    return texts.select("key", "n_words", "n_features", "buckets").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its rows numbered from 1 in the given order, by ranges: no task sees more than its range, and the driver only counts of rows."""
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))  # kept: a range must be the same for its count and its numbers
    part, at = free_name(df, "_part"), free_name(df, "_at")
    placed = ranges.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    starts, total = [], 0
    for k, n in sorted(placed.groupBy(part).count().collect()):
        starts.append((k, total))
        total += n
    before = free_name(df, "_before")
    known = F.broadcast(df.sparkSession.createDataFrame(starts, f"`{part}` long, `{before}` long"))  # a row for each range
    return placed.join(known, part).withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(part, at, before)


def noise(seed: str, *cols: Column) -> Column:
    """Gumbel noise times 1000, rounded down, from the SHA-256 of the seed and the columns as text (null: empty)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", buckets: int = 10_000, longest: int = 1, seed: str = "2024") -> DataFrame:
    """(id, key, n_words, n_features, weight, score) of every row of docs.

    target: rows with a text column.  A null text counts as empty: no features
    and weight 0.  Rows with equal ids get the same noise; a null id gets that
    of an empty one.  Other columns of docs, whatever their names, aren't read;
    an empty docs gives no rows, an empty target weighs by the smoothing alone.
    """
    texts = cut(collapsed(docs, text, buckets, longest))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(collapsed(target, text, buckets, longest), buckets), buckets)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("key"))
    found = rows.join(weights(texts, gain, buckets), "key")  # slim rows; AQE splits the key of a text with many copies
    return found.select("id", "key", "n_words", "n_features", "weight", (F.col("weight") + noise(seed, F.col("id"))).alias("score"))


def ranked(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, **settings) -> DataFrame:
    """scores() with rank: of the N rows with at least least_words words, the floor(percent * N / 100) highest scores get 1, 2, ...; others null.

    Ties go to the smaller id (null last), then to the smaller key; rows that
    agree in both are alike in all columns.
    """
    scored = cut(scores(docs, target, **settings))
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    placed = numbered(scored.where(fit), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("key").asc())
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.union(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are drawn, whole and with all their columns; settings as for ranked().

    Rows that agree in id and text are drawn together if one of them is.
    """
    id_col, text = settings.get("id_col", "doc_id"), settings.get("text", "text")
    drawn = ranked(docs, target, **settings).where("rank is not null").select(F.struct(F.col("id").alias("i"), F.col("key").alias("k")).alias("drawn")).distinct()
    own = F.struct(docs[id_col].alias("i"), F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256)).alias("k"))
    return docs.join(drawn, own.eqNullSafe(drawn["drawn"]), "left_semi")

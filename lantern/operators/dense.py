"""Exact dense search by blocked matrix products.

Vectors and queries are packed into blocks; a task multiplies blocks and keeps
the k best of each query so far, so what it sends on is bounded by its queries.
A block whose largest norm can't lift a query over its k-th best score so far is
skipped for that query.  Few blocks of queries go to every task; many are dealt
out with the vectors' blocks over a grid of tasks, so vectors are read once
however many queries there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries of one.
VECTORS, QUERIES = 4096, 512
#: Blocks of queries that go to every task.
SENT = 64


def packed(df: DataFrame, key: str, vector: str, on: list[str], size: int) -> DataFrame:
    """(n, keys, groups, matrix): blocks of up to size rows; keys and groups as arrays, matrix as packed doubles.  Rows without a vector are
    left out; vectors of different lengths in a block are an error.
    """
    kind = dict(df.dtypes)[key]
    group = F.to_json(F.struct(*on), {"ignoreNullFields": "false"}) if on else F.lit("")
    rows = df.where(F.col(vector).isNotNull()).select(key, group.alias("g"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                if len(flat) % part.num_rows or len(set(pc.list_value_length(part.column(2)).to_pylist())) > 1:
                    raise ValueError("vectors must all have one length")
                cols = [pa.array([part.num_rows], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)),
                    pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), pa.array([flat.astype(np.float64).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["n", "keys", "groups", "matrix"])

    return rows.mapInArrow(run, f"n int, keys array<{kind}>, groups array<string>, matrix binary")


class _Best:
    """The k best of each query, over the blocks that a task has seen."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, q_keys: list, q_groups: list, q: np.ndarray, keys: list, groups: list, v: np.ndarray) -> None:
        reach = np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0.0)
        least = np.array([self.held[i][self.k - 1][0] if len(self.held.get(i, ())) >= self.k else np.inf for i in q_keys])
        live = np.flatnonzero(reach + 1e-6 >= -least)
        if not len(live):
            return
        scores = np.round(q[live] @ v.T, 6) + 0.0
        own = np.array(groups, dtype=object)
        for row, j in zip(scores, live.tolist(), strict=True):
            allowed = np.flatnonzero(own == q_groups[j]) if q_groups[j] else np.arange(len(row))
            if len(allowed) > self.k:
                part = row[allowed]
                allowed = allowed[part >= np.partition(part, len(part) - self.k)[len(part) - self.k]]
            found = sorted([*self.held.get(q_keys[j], ()), *((-float(row[x]), keys[x], groups[x]) for x in allowed.tolist())], key=lambda x: x[:2])
            self.held[q_keys[j]] = found[: self.k]


def search(queries: DataFrame, vectors: DataFrame, k: int, *on: str) -> DataFrame:
    """Exact inner products of queries (query, qv, q_<on>...) with vectors (vec, v, <on>...), rounded to 6 places: (query, vec, <on>..., score, rank), the k best of each query among the vectors that are equal in on, equal scores by vec.

    Queries and vectors without a vector find nothing and aren't found, nor do
    those with a null in on; a query is a key.
    """
    asked = queries.select("query", "qv", *[F.col(f"q_{c}").alias(c) for c in on])
    if on:
        full = F.lit(True)
        for c in on:
            full = full & F.col(c).isNotNull()
        asked, vectors = asked.where(full), vectors.where(full)
    q = packed(asked, "query", "qv", list(on), QUERIES).select(F.col("n").alias("q_n"), F.col("keys").alias("q_keys"), F.col("groups").alias("q_groups"), F.col("matrix").alias("q_matrix"))
    v = packed(vectors, "vec", "v", list(on), VECTORS)
    blocks = q.count()
    if blocks <= SENT:
        pairs = v.crossJoin(F.broadcast(q))
    else:
        wide = -(-blocks // SENT)
        tall = vectors.sparkSession.sparkContext.defaultParallelism
        down, across = F.pmod(F.xxhash64("keys"), F.lit(tall)), F.pmod(F.xxhash64("q_keys"), F.lit(wide))
        v = v.withColumn("_p", down).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)).cast("array<bigint>")))
        q = q.withColumn("_g", across).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(tall - 1)).cast("array<bigint>")))
        pairs = v.join(q.hint("shuffle_hash"), ["_p", "_g"]).drop("_p", "_g")
    kinds = dict(asked.dtypes)["query"], dict(vectors.dtypes)["vec"]

    def run(batches):
        best, types = _Best(k), None
        for b in batches:
            types = b.schema.field("q_keys").type.value_type, b.schema.field("keys").type.value_type
            for r in b.to_pylist():
                matrix, own = np.frombuffer(r["matrix"]).reshape(r["n"], -1), np.frombuffer(r["q_matrix"]).reshape(r["q_n"], -1)
                best.add(r["q_keys"], r["q_groups"], own, r["keys"], r["groups"], matrix)
        if types:
            rows = [(i, x[1], x[2], -x[0]) for i, found in best.held.items() for x in found]
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((*types, pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["query", "vec", "g", "score"])

    found = pairs.mapInArrow(run, f"query {kinds[0]}, vec {kinds[1]}, g string, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec"))
    best = found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    shape = ", ".join(f"{c} {dict(vectors.dtypes)[c]}" for c in on)
    named = [F.from_json("g", shape)[c].alias(c) for c in on]
    return best.select("query", "vec", *named, "score", "rank")

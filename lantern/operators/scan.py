"""BM25 for many queries straight over texts, without an index.

A task turns its texts into blocks: a block's words, each with the documents that
have it.  One pass counts the queries' words, a second one scores every query
against every block where the block is and keeps the k best of each query, so
neither postings nor scores are shuffled or stored.  A block whose highest
impacts can't lift a query over its k-th best score so far is skipped for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut, slim_batches, small, spread
from .postings import _ALL, _SLACK, K1, B, best, idf

#: Documents of a block, and bytes of its tokens.
DOCS, BYTES = 2048, 16 << 20
#: Tokens of a block of queries, and blocks of queries that go to every task at once; more take more passes.
TOKENS, SENT = 65_536, 16


def _gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of size, but for the last and for those of over BYTES."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, size - sum(x.num_rows for x in held)))
            b = b.slice(held[-1].num_rows)
            if sum(x.num_rows for x in held) == size or sum(x.nbytes for x in held) > BYTES:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def packed(docs: DataFrame, doc: str, text: str, size: int = DOCS) -> DataFrame:
    """(docs, total, dl, words, df, at, tf): blocks of up to size documents and their length in all; at and tf are the documents (by place) and counts of the first word, then of the second, and so on, as packed 32-bit integers, dl the documents' lengths.

    Rows that repeat a doc are one document with the tokens of all of them and the length of the longest.
    """
    rows = spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text"))).select("doc", T.tokens(F.col("_text")).alias("t"))
    rows = rows.select("doc", F.size("t").alias("dl"), "t")
    if not docs.groupBy(doc).count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc").agg(F.max("dl").alias("dl"), F.flatten(F.collect_list("t")).alias("t"))
    kind = dict(rows.dtypes)["doc"]

    def run(batches):
        for part in _gathered(batches, size):
            n, told = part.num_rows, part.column(2)
            coded = told.flatten().dictionary_encode()
            words = len(coded.dictionary)
            place = np.repeat(np.arange(n), pc.list_value_length(told).to_numpy(zero_copy_only=False))
            found, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + place, return_counts=True)
            df = np.bincount(found // n, minlength=words).astype(np.int32)
            ints = [np.ascontiguousarray(x, dtype=np.int32).tobytes() for x in (part.column(1).to_numpy(zero_copy_only=False), found % n, tf)]
            cols = [pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([pc.sum(part.column(1)).as_py()], pa.int64()), pa.array([ints[0]], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), coded.dictionary), pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(df)),
                pa.array([ints[1]], pa.binary()), pa.array([ints[2]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["docs", "total", "dl", "words", "df", "at", "tf"])

    return rows.mapInArrow(run, f"docs array<{kind}>, total long, dl binary, words array<string>, df array<int>, at binary, tf binary")


class _Best:
    """The k best of each query, over the blocks that a task has seen."""

    def __init__(self, k: int, avgdl: float, k1: float, b: float):
        self.k, self.avgdl, self.k1, self.b, self.held = k, avgdl, k1, b, {}

    def add(self, docs: list, dl: np.ndarray, words: pa.Array, df: np.ndarray, at: np.ndarray, tf: np.ndarray, asked: pa.Array) -> None:
        """asked: struct<query, said: list<struct<qi, token, weight>>>, a query's tokens by qi."""
        queries, said = asked.field("query").to_pylist(), asked.field("said")
        own = np.repeat(np.arange(len(queries)), pc.list_value_length(said).to_numpy(zero_copy_only=False))
        token = said.flatten()
        word = pc.fill_null(pc.index_in(token.field("token"), value_set=words), -1).to_numpy(zero_copy_only=False)
        met = np.flatnonzero(word >= 0)
        if not len(met):
            return
        own, word = own[met], word[met]
        qi, weight = (token.field(c).to_numpy(zero_copy_only=False)[met] for c in ("qi", "weight"))
        impact = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[at] / self.avgdl))
        ends = np.cumsum(df)
        starts = ends - df
        bound = np.bincount(own, weight * np.maximum.reduceat(impact, starts)[word], len(queries))
        first_of = np.searchsorted(own, np.arange(len(queries) + 1))
        for j in np.flatnonzero(bound).tolist():
            held = self.held.get(queries[j], [])
            least = -held[self.k - 1][0] if len(held) >= self.k else -np.inf
            if bound[j] < least - _SLACK:
                continue
            mine = slice(first_of[j], first_of[j + 1])
            sizes = df[word[mine]]
            stops = np.cumsum(sizes)
            posting = np.arange(stops[-1]) + np.repeat(starts[word[mine]] - stops + sizes, sizes)
            place = at[posting]
            score = np.bincount(place, impact[posting] * np.repeat(weight[mine], sizes), len(docs))
            score = np.where(score > 0, np.floor(score * 1e6 + 0.5) / 1e6, -np.inf)
            if len(score) > self.k:
                least = max(least, np.partition(score, len(score) - self.k)[len(score) - self.k])
            chosen = np.flatnonzero((score >= least) & (score > -np.inf)).tolist()
            if chosen:
                first = np.zeros(len(docs), np.int64)
                first[place[::-1]] = np.repeat(qi[mine], sizes)[::-1]  # of a document's tokens the first is written last
                found = [*held, *((-float(score[x]), int(first[x]), docs[x]) for x in chosen)]
                self.held[queries[j]] = sorted(found, key=lambda x: (x[0], x[1], x[2] is not None, x[2]))[: self.k]


def search(docs: DataFrame, doc: str, text: str, q: DataFrame, k: int, *, k1: float = K1, b: float = B, size: int = DOCS) -> DataFrame:
    """(query, doc, score, first_qi, rank): what postings.search gives over blocks of the documents, for queries q (query, qi, token) that are asked once.

    Texts are tokenised in each of two passes; where the queries take several
    passes, the blocks are stored first.
    """
    slim_batches(docs.sparkSession)
    blocks = packed(docs, doc, text, size)
    counted = F.transform(F.arrays_zip("words", "df"), lambda x: F.struct(x["words"].alias("token"), x["df"].cast("long").alias("df"), F.lit(0).cast("long").alias("dl")))
    whole = F.struct(F.lit(_ALL).alias("token"), F.size("docs").cast("long").alias("df"), F.col("total").alias("dl"))
    wanted = q.select("token").union(q.sparkSession.createDataFrame([(_ALL,)], "token string")).distinct()
    counts = blocks.select(F.inline(F.concat(counted, F.array(whole)))).join(small(wanted), "token", "left_semi")
    counts = cut(counts.groupBy("token").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")))
    n_docs, total = counts.where(F.col("token") == _ALL).agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    avgdl = total / n_docs if n_docs else 0.0
    said = q.join(counts.where(F.col("token") != _ALL), "token").groupBy("query", "token").agg(F.sum(idf(F.lit(n_docs), F.col("df"))).alias("weight"), F.min("qi").alias("qi"))
    asked = cut(said.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("qi", "token", "weight"))).alias("said")))
    parts = -(-(asked.agg(F.coalesce(F.sum(F.size("said")), F.lit(0))).first()[0]) // TOKENS)
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(max(1, parts)))).groupBy("part").agg(F.collect_list(F.struct("query", "said")).alias("asked"))
    passes = max(1, -(-parts // SENT))
    if passes > 1:
        blocks, dealt = cut(blocks), cut(dealt)
    kinds = dict(asked.dtypes)["query"], dict(docs.select(F.col(doc)).dtypes)[doc]

    def run(batches):
        kept, types = _Best(k, avgdl, k1, b), None
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            types = column["asked"].type.value_type.field("query").type, column["docs"].type.value_type
            for r in range(batch.num_rows):
                row = {c: x[r] for c, x in column.items()}
                dl, at, tf = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("dl", "at", "tf"))
                kept.add(row["docs"].as_py(), dl, row["words"].values, row["df"].values.to_numpy(), at, tf, row["asked"].values)
        if types:
            rows = [(i, x[2], -x[0], x[1]) for i, found in kept.held.items() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((*types, pa.float64(), pa.int32()))], names=["query", "doc", "score", "first_qi"])

    found = None
    for i in range(passes):
        pairs = blocks.drop("total").crossJoin(F.broadcast(dealt.where(F.col("part") % passes == i).select("asked")))
        each = pairs.mapInArrow(run, f"query {kinds[0]}, doc {kinds[1]}, score double, first_qi int")
        found = each if found is None else found.unionByName(each)
    return best(found, k)

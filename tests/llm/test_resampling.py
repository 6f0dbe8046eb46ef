"""Importance resampling: against a plain version, copies, edge cases and the query against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

pytest.importorskip("lantern.llm")
from pyspark.sql import Row  # noqa: E402

from lantern.llm import queries as Q  # noqa: E402
from lantern.llm import resampling as R  # noqa: E402


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, buckets=10_000, longest=1, percent=10, least=20, seed="2024"):
    def found(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in target for b in found(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = found(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, len(plain_words(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((repr((*r, rank.get(id(r)))) for r in rows))


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (2, 97), (3, 70_000)])
def test_plain(spark, longest, buckets):
    words = "Alpha beta GAMMA straße Ünder 42 x_y z".split()
    docs = [(k, " ".join(words[(k * j * j + j) % 8] + ("," if j % 5 == 0 else "") for j in range(k % 60))) for k in range(300)]
    docs += [(300 + k, docs[59][1]) for k in range(200)] + [(900, None), (901, ""), (902, "\x00 -- \n"), (903, "é" * 100_000 + " a" * 30_000)]
    target = ["alpha beta gamma", None, "x y 42 42 straße"]
    got = R.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"),
        longest=longest, buckets=buckets, percent=30)
    assert sorted(repr((r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in got.collect()) == plain(docs, target, buckets, longest, 30)


def test_copies_cost_one_row(spark):
    docs = spark.createDataFrame([(k, "a hot text" if k % 3 else f"text {k}") for k in range(600)], "doc_id long, text string")
    texts = {r.copies for r in R.collapsed(docs).collect()}
    assert texts == {1, 400} and R.collapsed(docs).count() == 201


def test_edge_cases(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="a b", rank="r", score="s", key="k", id="i", copies=1)] * 2
        + [Row(doc_id=None, text="a b", rank="r", score="s", key="k", id="i", copies=1), Row(doc_id=2, text=None, rank="r", score="s", key="k", id="i", copies=1)])
    target = spark.createDataFrame([("a",)], "text string")
    got = sorted(repr((r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in R.ranked(docs, target, percent=100, least_words=1).collect())
    assert got == plain([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], ["a"], percent=100, least=1)
    drawn = R.resample(docs, target, percent=100, least_words=1)
    assert drawn.columns == docs.columns and drawn.count() == 3
    for d, t, n in ((docs.limit(0), target, 0), (docs, target.limit(0), 4), (docs.limit(0), target.limit(0), 0)):
        assert R.ranked(d, t).count() == n
    with pytest.raises(ValueError):
        R.collapsed(docs, buckets=0)


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).select("id", (R.F.col("id") * 7919 % 100).alias("v"))
    got = R.numbered(df.repartition(13), R.F.col("v").desc(), R.F.col("id").asc()).collect()
    want = sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 5001))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = Q.op11_importance_resampling(spark, d)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = c.sql(Q.oracle_sql()["op11_importance_resampling"])
    assert got.columns == want.columns and {k for _, k in got.dtypes} == {"bigint"}
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))

"""Poisson replication: the draw against a plain inversion, shares, and edge cases."""

import hashlib
import math

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import mixing as M  # noqa: E402


def plain_draw(doc_id, rate, seed="mix"):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u and k < 1000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_and_shares(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    w = spark.createDataFrame([("hot", 1.0), ("s1", 3.0), ("s2", 1.0), ("s4", 0.0), ("none", 9.0)], "source string, weight double")
    out = M.mix(docs, w, total=5000).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    share = {"hot": 0.2, "s1": 0.6, "s2": 0.2}
    for i, s in rows:
        assert got.get(i, 0) == (plain_draw(i, share[s] * 5000 / n[s]) if s in share else 0)
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert abs(sum(r.source == "s1" for r in out) / len(out) - 0.6) < 0.05


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "b", "y"), (4, "b", "")], "doc_id long, source string, RATE string")
    out = M.mix(docs, total=400).collect()
    by = {}
    for r in out:
        by[(r.doc_id, r.source)] = by.get((r.doc_id, r.source), 0) + 1
    assert by[(1, None)] % 2 == 0 and set(by) == {(1, None), (None, "b"), (4, "b")}
    assert M.mix(docs.limit(0)).collect() == []
    assert M.mix(docs, spark.createDataFrame([], "source string, weight double")).collect() == []


def test_large_mean_does_not_underflow(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(4)], "doc_id long, source string")
    n = M.mix(docs, total=8000).count()
    assert abs(n - 8000) < 600

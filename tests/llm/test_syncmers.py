"""Closed syncmers against a plain choice, the next row, and edge cases."""

import hashlib
import re

import pytest

pytest.importorskip("lantern.llm")
from pyspark.sql import functions as F  # noqa: E402

from lantern.llm import syncmers as Y  # noqa: E402


def hashes_of(spark, rows):
    """xxhash64 of each tuple of one width, by Spark."""
    rows = sorted(set(rows))
    if not rows:
        return {}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *[f"c{j}" for j in range(len(rows[0]))]])
    got = {r[0]: r[1] for r in df.select("i", F.xxhash64(*[f"c{j}" for j in range(len(rows[0]))])).collect()}
    return {r: got[i] for i, r in enumerate(rows)}


def plain_anchors(spark, texts, k, s):
    units = [re.findall(r"[^\x00-\x20]{1,16}", t.lower()) for t in texts]
    of = {u: h for (u,), h in hashes_of(spark, [(u,) for x in units for u in x]).items()}
    own = [[of[u] for u in x] for x in units]
    runs = hashes_of(spark, [tuple(x[i : i + s]) for x in own for i in range(len(x) - s + 1)]) if s > 1 else {(h,): h for x in own for h in x}
    wholes = hashes_of(spark, [tuple(x[i : i + k]) for x in own for i in range(len(x) - k + 1)])
    out = []
    for x in own:
        if len(x) < k:
            out.append(None if x else [])  # a short text is one anchor
            continue
        r = [runs[tuple(x[i : i + s])] for i in range(len(x) - s + 1)]
        out.append([wholes[tuple(x[i : i + k])] for i in range(len(x) - k + 1) if min(r[i : i + k - s + 1]) in (r[i], r[i + k - s])])
    return out


def plain_sketch(anchors, size):
    seen = list(dict.fromkeys((h & (2**64 - 1)) >> 32 for h in anchors))
    least = set(sorted(seen)[:size])
    return [h for h in seen if h in least]


def plain_likeness(a, b, size):
    union = sorted(set(a) | set(b))[:size]
    if not union:
        return 1.0
    breaks = lambda x, y: sum(y.index(q) < y.index(p) for p, q in zip(x, x[1:]))
    x, y = ([h for h in u if h in v and h in union] for u, v in ((a, b), (b, a)))
    return max(len(x) - max(breaks(x, b), breaks(y, a)), 0) / len(union)


TEXTS = ["", "one", "two words", "Three little words", "a b c d e f g", "x" * 50, " ".join(f"w{i * 7919 % 97}" for i in range(300)), " ".join(f"v{i * i % 1009}é" for i in range(400)), "rep eat " * 40]


@pytest.mark.parametrize("k,s", [(3, 1), (5, 2), (4, 1), (3, 2)])
def test_choice_matches_plain(spark, k, s):
    got = [r[0] for r in spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").orderBy("i").select(Y.anchors(F.col("t"), k, s)).collect()]
    for t, mine, want in zip(TEXTS, got, plain_anchors(spark, TEXTS, k, s)):
        assert mine == want if want is not None else len(mine) == 1, t


def test_sketch_and_likeness_match_plain(spark):
    long = TEXTS[6]
    texts = [*TEXTS, long[: len(long) * 3 // 4] + " other tail " * 20, long[600:] + " " + long[:600], " ".join(reversed(long.split()))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("m", Y.sketch(F.col("t"), 16)["words"])
    marks = {r.i: r.m for r in df.collect()}
    for i, want in enumerate(plain_anchors(spark, texts, Y.K, Y.S)):
        assert want is None or marks[i] == plain_sketch(want, 16)
    pairs = df.select(F.col("i").alias("a"), F.col("m").alias("x")).crossJoin(df.select(F.col("i").alias("b"), F.col("m").alias("y")))
    for r in pairs.withColumn("near", Y.matched(F.col("x"), F.col("y"), 16)).collect():
        assert r.near == pytest.approx(plain_likeness(marks[r.a], marks[r.b], 16)), (r.a, r.b)


def test_long_and_short_near_copies(spark):
    """A text against its beginning is as like as it is long, on both sides of the length from which there are no character anchors."""
    words = [f"w{i * 7919 % 9973}" for i in range(60)]
    assert len(" ".join(words)) > Y.SHORT > len(" ".join(words[:43]))
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:n])) for n in (43, 50, 55)], "a string, b string")
    got = [r[0] for r in df.select(Y.likeness(Y.sketch(F.col("a")), Y.sketch(F.col("b")))).collect()]
    assert all(abs(g - n / 60) < 0.12 for g, n in zip(got, (43, 50, 55)))


def test_edits_and_next(spark):
    rows = [(9, "Last " * 40), (3, "x y z"), (3, "a b"), (4, None), (7, ""), (None, "nul é " * 9), (5000, "abcd " * 30000), (90000, "Tail text " * 3), (2**40, "far away words")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, MARKS string")
    got = Y.with_edits(df).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows))
    want = []
    for k, (i, t) in enumerate(order):
        nxt, q = order[(k + 1) % len(order)][1], len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = Y.with_edits(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert Y.with_edits(df.limit(0)).collect() == []


def test_many_stretches(spark):
    ids = spark.range(3000).selectExpr("id * 37 - 5000 as doc_id", "cast(id as string) as text")
    got = {r.doc_id: r.next_text for r in Y.with_next(ids, "doc_id", ["text"], stretch=64).collect()}
    assert got == {i * 37 - 5000: str((i + 1) % 3000) for i in range(3000)}
    parts = spark.range(3000).selectExpr("id * 5 as _part")
    deep = {r[0]: r[1] for r in Y._before(parts, 3000, fan=16).collect()}
    assert deep == {i * 5: (i - 1) % 3000 * 5 for i in range(3000)}


def test_query_tells_edited_from_next(spark):
    from lantern.llm.queries import op4_document_fingerprints

    got = op4_document_fingerprints(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    by = {}
    for r in got:
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in got) > 0.98 * len(got)

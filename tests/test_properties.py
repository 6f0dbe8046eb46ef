"""Properties that hold for any input: drawn cases go through Spark as one table."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.functions import numbers as N
from lantern.functions import text as T
from lantern.operators import corpus as C
from lantern.operators import evaluate as E
from lantern.operators import retrieve as R


@settings(max_examples=200, deadline=None)
@given(st.integers(-50, 50), st.integers(-50, 50), st.sampled_from("+-*"))
def test_evaluate_agrees_with_python(a, b, op):
    assert N.evaluate(f"({a}) {op} ({b})") == {"+": a + b, "-": a - b, "*": a * b}[op]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_evaluate_never_raises(text):
    value = N.evaluate(text)
    assert value is None or isinstance(value, float)


def test_clean_twice_is_clean_once(spark):
    rng = random.Random(1)
    parts = ["[1]", "a b", "\n", "\n\n\n\n", "== Notes ==", "== X ==", "\t ", "Text. "]
    df = spark.createDataFrame([("x" + "".join(rng.choices(parts, k=rng.randint(0, 12))),) for _ in range(300)], "t string")
    once = T.clean_article(F.col("t"))
    assert df.where(T.clean_article(once) != once).count() == 0


def test_chunk_ids_are_contiguous_and_bounded(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(str(i), " ".join(f"w{j}" + rng.choice(["", "", ".", "?"]) for j in range(rng.randint(0, 200)))) for i in range(60)], "source string, text string")
    got = C.chunk(df, 25, 5).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("m"), F.max(T.word_count(F.col("text"))).alias("w")).collect()
    assert got and all(r.m == r.n - 1 and r.w <= 25 + 5 for r in got)


def test_fused_scores_fall_and_recall_grows(spark):
    rng = random.Random(3)
    lists = [(q, li, r + 1, k) for q in range(10) for li in range(3) for r, k in enumerate(rng.sample(range(30), 10))]
    fused = R.fuse(spark.createDataFrame(lists, "query int, list_id int, rank int, key int"), 30).orderBy("query", "rank").collect()
    for a, b in zip(fused, fused[1:]):
        assert a["query"] != b["query"] or a.score >= b.score
    found = spark.createDataFrame([(i, rng.choice([None, *range(1, 12)])) for i in range(100)], "query int, found_at int")
    r = E.recall(found, (1, 2, 5, 10), []).first()
    assert r.recall_1 <= r.recall_2 <= r.recall_5 <= r.recall_10 and r.recall_1 <= r.mrr <= 1


def test_sets_by_key(spark):
    rng = random.Random(4)
    a, b = (spark.createDataFrame([(k, s) for k in set(rng.choices(range(40), k=25))], "k int, v string") for s in ("a", "b"))
    union, less, both = E.set_union(a, b, ["k"]), E.set_difference(a, b, ["k"]), E.set_overlap(a, b, ["k"])
    assert union.count() == less.count() + b.count() and both.count() + less.count() == a.count()
    assert union.join(b.select("k"), "k").where("v <> 'b'").count() == 0


def test_strata_are_full_or_whole(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 * (id % 3) as s")
    sizes = {r.s: r.n for r in df.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.s: r.n for r in E.stratified(df, "s", 20, [F.xxhash64("id")]).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {s: min(20, n) for s, n in sizes.items()}

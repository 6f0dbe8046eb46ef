"""Text and number functions on hand-computed cases."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lantern.functions import numbers as N
from lantern.functions import text as T


def one(spark, value, *cols, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(*cols).first()


def test_tokens(spark):
    got = one(spark, "Niño's CAFÉ is the été_1, NOT no", T.tokens(F.col("x")), T.tokens(F.col("x"), False))
    assert got[0] == ["niño", "s", "café", "été_1", "not", "no"] and "the" in got[1]
    assert one(spark, None, T.tokens(F.col("x")))[0] == []


def test_clean_is_idempotent(spark):
    text = "A [1][2] b\n\n\n\nc\n== see ALSO ==\nx\n== Later ==\ny"
    once = one(spark, text, T.clean_article(F.col("x")))[0]
    assert once == "A b\n\nc" and one(spark, once, T.clean_article(F.col("x")))[0] == once


def test_truncate(spark):
    for text, most, want in (("One. Two three.", 8, "One."), ("no stop here at all", 9, "no stop"), ("x" * 30, 10, "x" * 10), ("Short.", 10, "Short."), ("Is 3.5 it? Yes", 11, "Is 3.5 it?")):
        assert one(spark, text, T.truncate(F.col("x"), most))[0] == want


def test_numbers(spark):
    r = spark.range(1).select(N.gcd(F.lit(48), F.lit(-18)), N.lcm(F.lit(4), F.lit(6)), N.mod_power(F.lit(7), F.lit(100), F.lit(13)), N.binomial_at_least(F.lit(10), F.lit(3), F.lit(0.5)), N.min_gap(F.array(F.lit(1), F.lit(9)), F.array(F.lit(12), F.lit(4)))).first()
    assert r[0] == 6 and r[1] == 12 and r[2] == pow(7, 100, 13) and r[4] == 3
    assert math.isclose(r[3], sum(math.comb(10, i) for i in range(3, 11)) / 1024)


def test_evaluate():
    assert N.evaluate("2**10 - comb(5, 2)") == 1014 and N.evaluate("-7 // 2") == -4 and N.evaluate("sqrt(2)*sqrt(2)") is not None
    for bad in ("", None, "x", "open('f')", "(1).__class__", "9**9**9", "factorial(10**9)", "1/0", "'a'*3", "[1]"):
        assert N.evaluate(bad) is None


def test_min_gap_and_binomials(spark):
    pairs = [([1, 9], [12, 4]), ([5], [5]), (list(range(0, 4000, 2)), [3999]), ([], [1]), ([7, 8], [1, 20])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<int>, b array<int>").orderBy("i")
    assert [r[0] for r in df.select(N.min_gap(F.col("a"), F.col("b"))).collect()] == [min((abs(x - y) for x in a for y in b), default=None) for a, b in pairs]
    cases = [(10, 3, 10, 0.5), (10, 0, 10, 0.2), (10, 11, 12, 0.2), (2000, 900, 1100, 0.5), (5, 5, 5, 0.9)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, lo int, hi int, p double").orderBy("i").select(N.binomial_between(F.col("n"), F.col("lo"), F.col("hi"), F.col("p"))).collect()
    for (n, lo, hi, p), r in zip(cases, got):
        assert math.isclose(r[0], float(sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(lo, min(hi, n) + 1))), rel_tol=1e-9, abs_tol=1e-12)


def test_option_values(spark):
    options = ["12.", "1e3", "€1,000", "30 kg", "30kg", "50%", "-2.50", "x", "$ 7", ".5", "", "1 2"]
    got = spark.createDataFrame(list(enumerate(options)), "i int, o string").orderBy("i").select(N.option_value(F.col("o"))).collect()
    assert [r[0] for r in got] == [12.0, 1000.0, 1000.0, 30.0, None, None, -2.5, None, 7.0, 0.5, None, None]


def test_argmax_and_margin(spark):
    m = F.create_map(F.lit("B"), F.lit(0.4), F.lit("A"), F.lit(0.4), F.lit("C"), F.lit(0.2))
    r = spark.range(1).select(N.argmax(m), N.margin(m)).first()
    assert r[0] == "A" and r[1] == 0.0


def test_normal_distribution_in_the_tails(spark):
    """Against the exact complementary error function and its inverse, to 12 places of the value itself."""
    import math
    from statistics import NormalDist

    from lantern.functions import tools as X

    xs = [k / 16 for k in range(-120, 400)] + [26.0, -6.0, 2.4999999, 2.5, 0.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-12, abs=0) for r in got if r.x < 26) and len(got) == len(xs)
    ps = [k / 200 for k in range(1, 200)] + [10.0**-k for k in range(3, 300, 7)] + [1 - 10.0**-k for k in range(3, 15)] + [0.0, 1.0, -0.5, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", X.normal_quantile(F.col("p"), F.lit(3.0), F.lit(2.0)).alias("x"), X.normal_quantile(F.col("p"), F.lit(0.0), F.lit(0.0)).alias("none"))
    for r in df.withColumn("back", X.normal_cdf("x", F.lit(3.0), F.lit(2.0))).collect():
        assert r.none is None
        if r.p is None or not 0 < r.p < 1:
            assert r.x is None and r.back is None
        else:
            assert r.back == pytest.approx(r.p, rel=1e-11, abs=0)
            if 1e-9 < r.p < 1 - 1e-9:
                assert r.x == pytest.approx(NormalDist(3.0, 2.0).inv_cdf(r.p), rel=1e-12, abs=1e-12)

"""Numeric, array and map functions as Column expressions."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda p: p / total)


def min_gap(a: Column, b: Column) -> Column:
    """The least distance between a position of a and one of b: of the positions of both in order, the nearest neighbours of different lists, or 0 if one is in both."""
    marked = F.sort_array(F.concat(F.transform(a, lambda x: F.struct(x.alias("p"), F.lit(0).alias("s"))), F.transform(b, lambda y: F.struct(y.alias("p"), F.lit(1).alias("s")))))
    far = F.lit(2**31 - 1)
    start = F.struct(far.alias("gap"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("s"))
    step = lambda acc, x: F.struct(F.when(acc["s"] != x["s"], F.least(acc["gap"], x["p"] - acc["p"])).otherwise(acc["gap"]).alias("gap"),
        x["p"].alias("p"), x["s"].alias("s"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(marked, start, step, lambda acc: acc["gap"]))


def margin(probs: Column) -> Column:
    """Best less second-best value of a map."""
    ranked = F.sort_array(F.map_values(probs), asc=False)
    return F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))


def argmax(probs: Column) -> Column:
    """The key of the largest value; of equal ones the least key."""
    best = F.array_max(F.map_values(probs))
    return F.array_min(F.map_keys(F.map_filter(probs, lambda k, v: v == best)))


def soft_one_hot(chosen: Column, confidence: Column) -> Column:
    """array of four: the confidence at the chosen index, the rest shared by the others."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == chosen, confidence).otherwise((1 - confidence) / 3))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's, in at most 92 steps: enough for any two longs."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"),
        F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return (a / gcd(a, b)).cast("bigint") * b


def mod_power(base: Column, exponent: Column, modulus: Column) -> Column:
    """base^exponent mod modulus by squaring; modulus under 2^31."""
    start = F.struct(F.lit(1).cast("bigint").alias("r"), F.pmod(base, modulus).cast("bigint").alias("b"), exponent.cast("bigint").alias("e"))

    def step(s, _):
        odd = s["e"] % 2 == 1
        return F.struct(F.when(odd, s["r"] * s["b"] % modulus).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % modulus).alias("b"), F.shiftright(s["e"], 1).alias("e"))

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, lambda s: s["r"]), modulus)


def binomial_between(n: Column, low: Column, high: Column, p: Column) -> Column:
    """P(low <= X <= high) for X ~ Bin(n, p) with 0 < p < 1, summed from its terms, each from the one before in logarithms."""
    start = F.struct((n * F.log(1 - p)).alias("log"), F.when(low <= 0, F.pow(1 - p, n)).otherwise(0.0).alias("sum"))

    def step(acc, i):
        log = acc["log"] + F.log((n - i + 1) / i) + F.log(p / (1 - p))
        return F.struct(log.alias("log"), (acc["sum"] + F.when((i >= low) & (i <= high), F.exp(log)).otherwise(0.0)).alias("sum"))

    terms = F.when(F.least(high, n) > 0, F.sequence(F.lit(1), F.least(high, n))).otherwise(F.array().cast("array<int>"))
    return F.when(low > n, 0.0).when(n.isNotNull() & low.isNotNull() & high.isNotNull() & p.isNotNull(), F.aggregate(terms, start, step, lambda acc: acc["sum"]))


def binomial_at_least(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p)."""
    return binomial_between(n, k, n, p)


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}
_CALLS = {
    "abs": abs, "round": round, "min": min, "max": max, "sqrt": math.sqrt, "log": math.log, "log2": math.log2, "log10": math.log10, "sin": math.sin,
        "cos": math.cos, "tan": math.tan,
    "gcd": math.gcd, "comb": math.comb, "perm": math.perm, "factorial": math.factorial,
}


def evaluate(text: str | None) -> float | None:
    """The value of an arithmetic expression; null for anything else.  Nothing is executed: the syntax tree is walked."""
    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.Name) and node.id in ("pi", "e"):
            return getattr(math, node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow):
                if abs(b) > 1000 or (abs(a) > 1 and abs(b) * math.log2(abs(a)) > 4000):
                    raise ValueError("too large")
                return a**b
            return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            args = [value(a) for a in node.args]
            if node.func.id in ("factorial", "comb", "perm") and max(args) > 1000:
                raise ValueError("too large")
            return _CALLS[node.func.id](*args)
        raise ValueError("not arithmetic")

    try:
        if not text or len(text) > 500:
            return None
        out = float(value(ast.parse(text.strip(), mode="eval").body))
        return out if math.isfinite(out) else None
    except (ValueError, SyntaxError, KeyError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


@F.pandas_udf(DoubleType())
def arithmetic(text: pd.Series) -> pd.Series:
    """Each row's own expression text, so no column expression can stand for it."""
    return text.map(evaluate).astype("float64")


def option_value(option: Column) -> Column:
    """An option's number, without currency signs, thousands commas, a unit after a blank and a full stop; null if it has none."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(option, r"[€$£,]", ""), r"(?s)\s+[a-zA-Z].*", ""), r"^\s+|\s+$", "")
    bare = F.regexp_replace(bare, r"\.+$", "")
    return F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), bare.try_cast("double"))


def match_option(result: Column, options: Column) -> Column:
    """The first option within max(1e-9, |result| * 1e-9) of the result, if three or more options are numbers; else null."""
    values = F.transform(options, option_value)
    near = F.transform(values, lambda v: F.coalesce(F.abs(v - result) <= F.greatest(F.lit(1e-9), F.abs(result) * 1e-9), F.lit(False)))
    enough = F.size(F.filter(values, lambda v: v.isNotNull())) >= 3
    at = F.array_position(near, True)
    return F.when(enough & (at > 0), at - 1)

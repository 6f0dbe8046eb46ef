"""Deterministic tools: questions in words to numbers, and numbers to options.

Rules are regular expressions and closed forms as Column expressions; only the
general expression needs a pandas UDF.  What asks for algebra is in closed.py.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N

# Number words.
NUMBER_WORDS = (
    ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10), ("eleven", 11),
        ("twelve", 12), ("thirteen", 13), ("fourteen", 14),
    ("fifteen", 15), ("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50), ("sixty", 60), ("seventy", 70), ("eighty", 80), ("ninety", 90), ("hundred", 100),
)
_NUM = r"(-?\d+(?:\.\d+)?)"


def digits(text: Column) -> Column:
    """Number words as digits."""
    for word, value in NUMBER_WORDS:
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", str(value))
    return text


# Arithmetic in words, and what introduces it.
IN_WORDS = (
    (rf"(?i){_NUM}\s*(?:%|percent)\s+of\s+{_NUM}", "$1/100*$2"), (rf"(?i){_NUM}\s+to\s+the\s+power\s+of\s+{_NUM}", "$1**$2"),
        (rf"(?i)square\s+root\s+of\s+{_NUM}", "sqrt($1)"), (r"(?i)\s*\bsquared\b", "**2"), (r"(?i)\s*\bcubed\b", "**3"),
    (r"(?i)\btimes\b|×", "*"), (r"(?i)\bdivided\s+by\b|÷", "/"), (r"(?i)\bplus\b", "+"), (r"(?i)\bminus\b", "-"),
)
KEPT = r"[^0-9+\-*/().,a-zA-Z_\s]"
ASKED = r"(?is)(?:what\s+is(?:\s+the(?:\s+\w+){0,3})?|calculate|compute|find\s+the\s+value\s+of|evaluate|simplify|how\s+(?:many|much|far|long)|(?:find|determine)\s+the\s+(?:total|sum|product|result|answer))\s+(.+)"


def to_expression(question: Column) -> Column:
    """The arithmetic that a question states in words, or null."""
    q = question
    for pattern, new in IN_WORDS:
        q = F.regexp_replace(q, pattern, new)
    asked = F.regexp_extract(q, ASKED, 1)
    asked = F.element_at(F.split(F.regexp_replace(asked, r"[?\s]+\z", ""), r"(?i)\b(?:where|if|given)\b"), 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(asked, KEPT, " "), r"\s+", " "))
    return F.nullif(bare, F.lit(""))


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double")


def _long(text: Column, pattern: str, i: int) -> Column:
    return _group(text, pattern, i).cast("bigint")


# How a text states a probability, how many trials there are, and how many successes.
RATE = r"(?i)(\d+(?:\.\d+)?)\s+(?:became|are|were|out\s+of)\s+\S*\s*(?:\S+\s+)?(\d+(?:\.\d+)?)|(\d+(?:\.\d+)?)\s+of\s+(?:the\s+)?(\d+(?:\.\d+)?)"
TRIALS = r"(?i)(\d+)\s+(?:cyclones?|tosses?|trials?|rolls?|children|patients?|flips?|at[\s\-]?bats?|games?|attempts?|observations?|people|students?)"
SUCCESSES = r"(?i)(\d+)\s+(?:hits?|successes?)\s+in\s+(\d+)"
EVERY_TIME = r"(?i)(\d+)\s+(?:hits?|successes?)\s+in\s+\1"
SAMPLE = r"(?i)(\d+)\s+(?:jars?|samples?|observations?|subjects?|tablets?|items?)|(?:sample\s+of\s+|selected\s+at\s+random\s*)(\d+)"
PERCENTILE = r"(?i)(\d+)(?:st|nd|rd|th)\s+percentile"
#: Trials up to which a binomial tail is summed.
MOST_TRIALS = 1_000_000


def _ratio(a: Column, b: Column) -> Column:
    """The smaller of two different positive numbers over the larger."""
    return F.when((a > 0) & (b > 0) & (a != b), F.least(a, b) / F.greatest(a, b))


def probability(text: Column) -> Column:
    """A probability that a text states: a rate, the first two different numbers, a decimal or a percentage, whichever is first among these."""
    rate = _ratio(F.coalesce(_group(text, RATE, 1), _group(text, RATE, 3)), F.coalesce(_group(text, RATE, 2), _group(text, RATE, 4)))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)), lambda n: n.cast("double"))
    some = F.array_distinct(F.filter(found, lambda n: n.between(0.01, 100.0)))
    dot = F.nullif(F.regexp_extract(text, r"(?<!\d)0?(\.\d+)\b", 1), F.lit("")).try_cast("double")
    return F.coalesce(rate, _ratio(F.get(some, F.lit(0)), F.get(some, F.lit(1))), F.when(dot > 0, dot), _group(text, r"(\d+(?:\.\d+)?)\s*%", 1) / 100)


def _binomials(question: Column) -> Column:
    """array of P(X >= k), p^k and P(X = k), each null unless a question asks for it."""
    asked = N.let(
        digits(question),
        lambda d: F.struct(
            F.coalesce(_long(d, TRIALS, 1), _long(d, SUCCESSES, 2)).cast("int").alias("n"), _long(d, r"(?i)at\s+least\s+(\d+)", 1).cast("int").alias("least"),
            _long(d, r"(?i)exactly\s+(\d+)", 1).cast("int").alias("just"), _long(d, EVERY_TIME, 1).alias("again"), probability(question).alias("p"),
        ),
    )

    def results(x):
        ok = (x["p"] > 0) & (x["p"] < 1)
        p, n = F.when(ok, x["p"]), F.when(x["n"] <= MOST_TRIALS, x["n"])
        return F.array(N.binomial_between(n, x["least"], n, p), F.pow(p, x["again"]), N.binomial_between(n, x["just"], x["just"], p))

    return N.let(asked, results)


def binomial(question: Column) -> Column:
    """P(X >= k), p^k or P(X = k), by what a question asks first."""
    return N.let(_binomials(question), lambda r: F.coalesce(r[0], r[1], r[2]))


def _normal_parts(question: Column, mean: str) -> tuple[Column, Column, Column]:
    """Number words as digits, mean and standard deviation."""
    d = digits(question)
    return d, _group(d, rf"(?i){mean}\s+(?:of\s+)?(\d+(?:\.\d+)?)", 1), _group(d, r"(?i)standard\s+deviation\s+(?:of\s+)?(\d+(?:\.\d+)?)", 1)


def percentile(question: Column) -> Column:
    """struct<value, distance>: the percentile of a normal distribution that a question asks for, and how far from the mean it is, to two places."""
    d, mean, deviation = _normal_parts(question, "mean")
    at = normal_quantile(_group(d, PERCENTILE, 1) / 100, mean, deviation)
    return F.when(at.isNotNull(), F.struct(at.alias("value"), F.bround(F.abs(at - mean), 2).alias("distance")))


def sample_mean(question: Column) -> Column:
    """P(mean of a sample < x) of a normal distribution."""
    d, mean, deviation = _normal_parts(question, "(?:average|mean)")
    n = F.coalesce(_group(d, SAMPLE, 1), _group(d, SAMPLE, 2))
    return normal_cdf(_group(d, r"(?i)less\s+than\s+(\d+(?:\.\d+)?)", 1), mean, deviation / F.sqrt(F.nullif(n, F.lit(0.0))))


def match_probability(value: Column, options: Column) -> Column:
    """The option with the value to four places, else the first whose first number is within half a percentage point."""
    return F.coalesce(N.match_option(F.bround(value, 4), options), match_near(value, options, 0.005))


def solve_statistics(question: Column, options: Column) -> Column:
    """The option of the first statistics rule whose result is among them: a binomial tail, repeated success, exactly so many, a percentile, a sample's mean."""
    def of(x):
        of_binomials = [match_probability(x["binomials"][i], options) for i in range(3)]
        of_percentile = [N.match_option(x["at"]["value"], options), N.match_option(x["at"]["distance"], options), match_near(x["at"]["distance"], options)]
        return F.coalesce(*of_binomials, *of_percentile, match_probability(x["mean"], options))

    return N.let(F.struct(_binomials(question).alias("binomials"), percentile(question).alias("at"), sample_mean(question).alias("mean")), of)


#: Terms of the series of erf, and of the continued fraction of erfc; where one takes over from the other.
_TERMS, _TURN = 40, 2.5


def erfc(x: Column) -> Column:
    """The complementary error function, to 12 places of any value, tails included: a series of positive terms near 0, beyond it a continued fraction from its far end."""

    def series(a: Column) -> Column:
        start = F.struct(a.alias("sum"), a.alias("term"))

        def step(s, n):
            term = s["term"] * 2 * a * a / (2 * n + 1)
            return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

        total = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda s: s["sum"])
        return 1 - 2 / F.sqrt(F.pi()) * F.exp(-a * a) * total

    def fraction(a: Column) -> Column:
        below = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), a, lambda f, k: a + k / F.lit(2.0) / f)
        return F.exp(-a * a) / F.sqrt(F.pi()) / below

    upper = lambda x: N.let(F.abs(x), lambda a: F.when(a < _TURN, series(a)).otherwise(fraction(a)))
    return N.let(x.cast("double"), lambda x: N.let(upper(x), lambda u: F.when(x >= 0, u).otherwise(2 - u)))


def normal_cdf(x: Column | str, mean: Column, deviation: Column) -> Column:
    """P(X < x) of a normal distribution; null for a deviation that isn't positive."""
    x = F.col(x) if isinstance(x, str) else x
    given = F.struct(x.alias("x"), mean.alias("mean"), deviation.alias("deviation"))
    return N.let(given, lambda g: F.when(g["deviation"] > 0, erfc((g["mean"] - g["x"]) / g["deviation"] / F.sqrt(F.lit(2.0))) / 2))


def normal_quantile(p: Column, mean: Column, deviation: Column) -> Column:
    """Where a normal distribution has the share p below; null unless 0 < p < 1 and the deviation is positive.

    A rational first guess, within 0.0005, is improved by two steps of Halley's
    method on the lower tail, where nothing cancels.
    """
    # The coefficients of the first guess.
    def guess(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return N.let(t, lambda t: (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) - t)

    def better(z: Column, q: Column) -> Column:
        def step(z):
            off = (erfc(-z / F.sqrt(F.lit(2.0))) / 2 - q) * F.sqrt(2 * F.pi()) * F.exp(z * z / 2)
            return N.let(off, lambda e: z - e / (1 + z * e / 2))

        return N.let(z, step)

    def lower(q: Column) -> Column:
        return better(better(guess(q), q), q)

    def of(g: Column) -> Column:
        p = g["p"]
        z = N.let(F.least(p, 1 - p), lower) * F.when(p > 0.5, -1).otherwise(1)
        return F.when((p > 0) & (p < 1) & (g["deviation"] > 0), g["mean"] + g["deviation"] * z)

    return N.let(F.struct(p.alias("p"), mean.alias("mean"), deviation.alias("deviation")), of)


def match_near(value: Column, options: Column, tolerance: float = 0.01) -> Column:
    """The first option whose first number is within the tolerance."""
    near = F.transform(options, lambda o: F.coalesce(F.abs(F.nullif(F.regexp_extract(o, _NUM, 1), F.lit("")).try_cast("double") - value) <= tolerance, F.lit(False)))
    at = F.array_position(near, True)
    return F.when(at > 0, at - 1)


def tool_call(text: Column) -> Column:
    """struct<tool, argument> of 'CALL: tool(argument)' with balanced parentheses; null without one."""
    head = r"(?is)CALL\s*:\s*(\w+)\s*\((.*)\z"
    rest = F.regexp_extract(text, head, 2)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(s, c):
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when((s["end"] < 0) & (depth == 0), s["at"]).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.filter(F.split(rest, ""), lambda c: c != ""), start, step, lambda s: s["end"])
    return F.when(end >= 0, F.struct(F.lower(F.regexp_extract(text, head, 1)).alias("tool"), F.substring(rest, F.lit(1), end).alias("argument")))


def rewritten(raw: Column) -> Column:
    """The expression line of a model's rewrite; null for NONE, for prose and for what has no operator."""
    bare = F.trim(F.regexp_replace(raw, r"```[a-z]*\n?", ""))
    lines = F.filter(F.transform(F.split(bare, r"\r?\n"), F.trim), lambda s: s.rlike(r"[a-zA-Z0-9_(]"))
    first = F.get(lines, F.lit(0))
    prose = first.rlike(r"(?i)\b(?:the|is|of|to|and|for|that|this|you|we|it|a|an|from|import|print|return|def|class|if|else|while)\b")
    return F.when((F.upper(bare) != "NONE") & ~prose & first.rlike(r"[+\-*/()=,]"), first)

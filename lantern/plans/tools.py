"""Queries of the tools, prompts and the composed retrieval.  Questions are made from rows of the tables; SQL computes their answers from the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import closed as C
from ..functions import numbers as N
from ..functions import prompts as P
from ..functions import text as T
from ..functions import tools as X
from ..operators import corpus as C2
from ..operators import postings, rag, scan
from ..operators import retrieve as R
from ..operators.corpus import with_prefix
from ..operators.evaluate import recall
from ..shared import cut, small
from .common import LOG, query, runlog, table
from .corpus import KEPT
from .retrieve import _FUSED, _GOLD, _HITS, _gold


#: Parameters of the questions that are made from events.
_E = "SELECT event_id, event_id % 23 AS r, event_id % 7 + 2 AS a, event_id % 5 + 3 AS b, event_id % 11 + 1 AS c FROM events"
_LCM = "({0} // gcd({0}, {1}) * {1})"
_THREE = "lcm(lcm(a, b), c)"


def _events(spark, d, kinds):
    e = table(spark, d, "events").select("event_id")
    return e.select("event_id", (F.col("event_id") % kinds).alias("r"), (F.col("event_id") % 7 + 2).alias("a"),
        (F.col("event_id") % 5 + 3).alias("b"), (F.col("event_id") % 11 + 1).alias("c"))


def _said(forms):
    """The text of form r: a printf format and its arguments, columns or expressions."""
    out = F.lit(None).cast("string")
    for i, (text, *args) in enumerate(forms):
        out = F.when(F.col("r") == i, F.format_string(text, *[F.expr(x) for x in args])).otherwise(out)
    return out


# By r: wording, arguments, the rule that answers it, and SQL of both parts of the answer.
_SYMBOLIC = [
    (("What is the remainder when $%d^{%d}+%d$ is divided by $7$?", "a", "b", "c"), 8, "(CAST(power(a, b) AS BIGINT) + c) % 7", "NULL"),
    (("Compute $\\dbinom{%d}{%d}$.", "a + b", "b"), 4, "factorial(CAST(a + b AS INTEGER)) / (factorial(CAST(a AS INTEGER)) * factorial(CAST(b AS INTEGER)))", "0"),
    (("What is \\log_%d %d", "a", "cast(pow(a, b) as bigint)"), 10, "b", "NULL"),
    (("What is the value of %d^2 + %d^2 + ... + %d^2?", "a", "a + 1", "a + b"), 11, "(SELECT sum(i * i) FROM range(a, a + b + 1) t(i))", "NULL"),
    (("One bus leaves every %d minutes, another every %d minutes. How many times do they leave together?", "a", "b"), 13, "1440 // lcm(a, b)", "NULL"),
    (("Red blinks every %d seconds, blue every %d seconds and green every %d seconds. How often together in a %d-minute show?", "a", "b", "c", "c"),
        7, f"c * 60 // {_THREE} + 1", "NULL"),
    (("A shop has %d boxes; %d contain pens, %d contain ink and %d contain neither.", "a + b + c", "a + b", "b + c", "a"), 14, "a + b + b + c - (b + c)", "NULL"),
    (("A correlation of 0.%d is how many times a correlation of 0.%d?", "a", "b"), 15, "power(CAST(a AS DOUBLE) / b, 2)", "NULL"),
    (("In how many ways can %d different books be arranged on a shelf?", "a"), 17, "factorial(CAST(a AS INTEGER))", "NULL"),
    (("Points (%d, %d) and (%d, %d) are opposite vertices of a square. What is the area?", "a", "b", "b + 1", "c"), 20,
        "((a - b - 1) * (a - b - 1) + (b - c) * (b - c)) / 2.0", "NULL"),
    (("In 1990 there were %d cases and in 2000 there were %d cases. How many in 199%d?", "a * 100", "c * 100", "b"), 21, "a * 100 + (c - a) * 100 * b / 10.0", "NULL"),
    (("Let h(%dx - 1) = %dx + %d. For what value of x is h(x) = x?", "a + 9", "b", "c"), 6, "(c * (a + 9) + b) / CAST(a + 9 - b AS DOUBLE)", "NULL"),
    (("What is the reciprocal of 0.%d\\overline{%d}?", "b", "a"), 1, "90.0 / (b * 10 + a - b)", "NULL"),
    (("How many combinations of %d from %d are there?", "b", "a + b"), 16,
        "factorial(CAST(a + b AS INTEGER)) / (factorial(CAST(a AS INTEGER)) * factorial(CAST(b AS INTEGER)))", "NULL"),
    (("The equation x^2 - %dx + %d = 0 has which positive difference of solutions?", "2 * a + b", "a * (a + b)"), 12, "b", "0"),
    (("If %dx + %d = %d, then x = ?", "a", "b", "b + a * c"), 18, "c", "0"),
    (("What is the maximum value of $-x^2+%dx+%d$?", "a", "c"), 19, "a * a / 4.0 + c", "0"),
    (("What is the range of y = %d + %d*sin(pi - x)?", "a", "b"), 3, "a - b", "a + b"),
    (("2x + 3y = %d and 1x - 1y = %d, what is x + y?", "2 * a + 3 * b", "a - b"), 2, "a + b", "NULL"),
    (("Find the equation of the line tangent to y = %dx^2 at x = %d.", "a", "b"), 5, "2 * a * b", "-a * b * b"),
    (("(i + %d)(%d - %di) =", "a", "b", "c"), 22, "a * b + c", "b - a * c"),
    (("Evaluate $\\frac{%d}{%d}+%d\\cdot 2$", "a", "b", "c"), 4, "CAST(a AS DOUBLE) / b + 2 * c", "0"),
    (("It is $%d^{2}-%d$ in all.", "a", "b"), 23, "a * a - b", "0"),
]
_BY_R = lambda i, kind: "CASE r " + " ".join(f"WHEN {r} THEN CAST({f[i]} AS {kind})" for r, f in enumerate(_SYMBOLIC)) + " END"


@query(f"WITH e AS ({_E}) SELECT event_id, {_BY_R(1, 'INTEGER')} AS rule, round({_BY_R(2, 'DOUBLE')}, 6) AS value, round({_BY_R(3, 'DOUBLE')}, 6) AS other FROM e")
def symbolic_rules(spark, d):
    """M-11, §2.8.1 rows 1 to 23: a question in each rule's wording, the rule that answers it and its answer."""
    asked = _events(spark, d, len(_SYMBOLIC)).withColumn("q", _said([f[0] for f in _SYMBOLIC]))
    return asked.select("event_id", C.closed_form(F.col("q")).alias("s")).select("event_id", "s.rule", F.round("s.a", 6).alias("value"), F.round("s.b", 6).alias("other"))


# By r: wording, arguments, and options with the right one first.
_CHOICES = [
    (("What is the remainder when %d^%d is divided by 13?", "a", "b"), ["pmod(cast(pow(a, b) as bigint), 13)", "13", "14", "15"], "%d"),
    (("What is 0.%d\\overline{%d}?", "b", "a"), ["b * 10 + a - b", "1", "2", "3"], "\\frac{%d}{90}"),
    (("What is the range of y = %d - %d*cos(x)?", "a", "b"), ["a", "a + 1", "a + 2", "a + 3"], None),
    (("The line tangent to y = %dx^2 at x = %d is", "a", "b"), ["2 * a * b", "2 * a * b + 1", "2 * a * b + 2", "2 * a * b + 3"], "y = %dx"),
    (("(%d + 2i)(1 - i) =", "a"), ["a + 2", "a + 3", "a + 4", "a + 5"], "%d + 5i"),
    (("Nothing to solve in %d", "a"), ["a", "b", "c", "r"], "%d"),
]


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 4 END AS choice FROM events")
def matched_options(spark, d):
    """M-12: numbers, fractions, ranges, lines and complex numbers among options, the right one at event_id % 4."""
    asked = _events(spark, d, len(_CHOICES)).withColumn("q", _said([f[0] for f in _CHOICES]))
    options = F.lit(None).cast("array<string>")
    for i, (_, values, form) in enumerate(_CHOICES):
        if form is None:
            each = [F.format_string("%d <= y <= %d", F.expr(f"{v} - b"), F.expr("a + b")) for v in values]
        elif i == 3:
            each = [F.format_string("y = %dx - %d", F.expr(v), F.expr("a * b * b")) for v in values]
        elif i == 4:
            each = [F.format_string("%d %s %di", F.expr(v), F.expr("if(a > 2, '-', '+')"), F.expr("abs(2 - a)")) for v in values]
        else:
            each = [F.format_string(form, F.expr(v)) for v in values]
        options = F.when(F.col("r") == i, F.array(*each)).otherwise(options)
    turned = asked.withColumn("o", options).withColumn("k", (F.col("event_id") % 4).cast("int"))
    turned = turned.withColumn("o", F.concat(F.slice("o", F.lit(5) - F.col("k"), F.col("k")), F.slice("o", F.lit(1), 4 - F.col("k"))))
    return turned.select("event_id", C.solve(F.col("q"), F.col("o")).cast("bigint").alias("choice"))


@query(f"WITH e AS ({_E}) SELECT event_id, CASE WHEN c = 1 THEN NULL ELSE CAST(a AS DOUBLE) END AS x, CASE WHEN c = 1 THEN NULL ELSE CAST(b AS DOUBLE) END AS y FROM e")
def linear_systems(spark, d):
    """§2.8.1 row 2: two unknowns; parallel lines have no answer."""
    e = _events(spark, d, 23)
    q = F.format_string("$%dx + 2y = %d$ and $%dx + %dy = %d$. Find x - y.", F.col("c"), F.expr("c * a + 2 * b"), F.lit(1), F.lit(2), F.expr("a + 2 * b"))
    return e.select("event_id", C.system(q).alias("s")).select("event_id", F.round("s.x", 6).alias("x"), F.round("s.y", 6).alias("y"))


_TERM = "factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER))) * power(p, i) * power(1 - p, n - i)"


@query(f"WITH e AS (SELECT *, r % 3 AS kind, a + b AS n, b AS k, a / 9.0 AS p FROM ({_E})) SELECT event_id, round(CASE kind"
    f" WHEN 0 THEN (SELECT sum({_TERM}) FROM range(k, n + 1) t(i)) WHEN 1 THEN power(p, k) ELSE (SELECT sum({_TERM})"
    f" FROM range(k, k + 1) t(i)) END, 9) AS p FROM e")
def binomial_questions(spark, d):
    """M-09, M-10: binomial questions in words."""
    e = _events(spark, d, 23)
    rate = F.format_string("When %d out of 9 tries succeed, what is the probability of ", F.col("a"))
    asked = F.when(F.col("r") % 3 == 0, F.format_string("at least %d successes in %d trials?", F.col("b"), F.expr("a + b"))).when(F.col("r") % 3 == 1,
        F.format_string("%d hits in %d at-bats?", F.col("b"), F.col("b")))
    asked = asked.otherwise(F.format_string("exactly %d successes in %d trials?", F.col("b"), F.expr("a + b")))
    return e.select("event_id", F.round(X.binomial(F.concat(rate, asked)), 9).alias("p"))


_PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(t) FROM (SELECT exp((2 * k + 1) * ln(abs(z)) - (SELECT coalesce(sum(ln(2 * j + 1)), 0) FROM range(0, k + 1) u(j))) * sign(z) AS t FROM range(0, 100) v(k)))"


@query(f"WITH e AS (SELECT *, (b + 0.5 - a) / ((c + 10) / sqrt(CAST(a * a AS DOUBLE))) AS z FROM ({_E})) SELECT event_id, round({_PHI}, 6) AS below"
    f", CAST(c * 8 AS DOUBLE) / 100 AS share FROM e")
def normal_questions(spark, d):
    """M-10: sample means and percentiles of the normal distribution; the share below a percentile is the percentile."""
    e = _events(spark, d, 23)
    mean = F.format_string("An average of %d grams and a standard deviation of %d. What is the chance that a sample of %d has a mean less than %d.5?",
        F.col("a"), F.expr("c + 10"), F.expr("a * a"), F.col("b"))
    at = F.format_string("With a mean of %d and a standard deviation of %d, what is the %dth percentile?", F.col("a"), F.col("b"), F.expr("c * 8"))
    found = e.select("event_id", "a", "b", X.sample_mean(mean).alias("below"), X.percentile(at)["value"].alias("value"))
    return found.select("event_id", F.round("below", 6).alias("below"), F.round(X.normal_cdf("value", F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("share"))


# By r: wording, arguments, SQL of the expression and of its value.
_WORDS = [
    (("What is %d%% of %d?", "a", "c"), "a || '/100*' || c", "a / 100.0 * c"),
    (("Calculate %d to the power of %d", "a", "b"), "a || '**' || b", "power(a, b)"),
    (("What is the square root of %d?", "a * a"), "'sqrt(' || a * a || ')'", "a"),
    (("compute %d squared minus %d times %d", "a", "b", "c"), "a || '**2 - ' || b || ' * ' || c", "a * a - b * c"),
    (("Find the total %d plus %d divided by %d if that is so", "a", "b", "c"), "a || ' + ' || b || ' / ' || c", "a + b / CAST(c AS DOUBLE)"),
    (("Who was number %d?", "a"), "NULL", "NULL"),
]
_OF_WORDS = lambda i, kind: "CASE event_id % 6 " + " ".join(f"WHEN {r} THEN CAST({f[i]} AS {kind})" for r, f in enumerate(_WORDS)) + " END"


@query(f"WITH e AS ({_E}) SELECT event_id, {_OF_WORDS(1, 'VARCHAR')} AS expr, round({_OF_WORDS(2, 'DOUBLE')}, 9) AS value FROM e")
def word_arithmetic(spark, d):
    """M-07, M-06: English to arithmetic, evaluated."""
    e = _events(spark, d, len(_WORDS)).select("event_id", X.to_expression(_said([f[0] for f in _WORDS])).alias("expr"))
    return e.select("event_id", "expr", F.round(N.arithmetic(F.col("expr")), 9).alias("value"))


@query(f"WITH e AS ({_E}) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'calc' WHEN 1 THEN 'look_up' END AS tool, CASE event_id % 4"
    f" WHEN 0 THEN 'factorial(' || a || ') + (' || b || ')' WHEN 1 THEN '' END AS argument FROM e")
def tool_calls(spark, d):
    """X-12: calls with balanced parentheses."""
    said = _said([("so CALL: Calc(factorial(%d) + (%d)) done (%d)", "a", "b", "c"), ("CALL: look_up() of %d", "a"), ("call : X (%d", "a"), ("none of %d", "a")])
    return _events(spark, d, 4).select("event_id", X.tool_call(said).alias("c")).select("event_id", "c.tool", "c.argument")


@query(f"WITH e AS ({_E}) SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'solve(x**2 - ' || a || ', x)' WHEN 3 THEN a || '*' || b END AS expr FROM e")
def rewrite_lines(spark, d):
    """X-16: the expression in a rewrite."""
    said = _said([("```python\nsolve(x**2 - %d, x)\n```", "a"), ("NONE",), ("The answer is %d+%d", "a", "b"), ("\n%d*%d\nmore", "a", "b"), ("abc",)])
    return _events(spark, d, 5).select("event_id", X.rewritten(said).alias("expr"))


@query("SELECT conv_id, turn, 'Question: ' || coalesce(text, '') || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. 1' || chr(10) || 'B. 2' || chr(10) || 'C. 3' || chr(10) || 'D. 4' || chr(10) || chr(10) ||"
    " CASE WHEN turn % 2 = 0 THEN ''"
    " ELSE 'Reference material (may or may not be relevant):' || chr(10) || role || chr(10) || chr(10) END || 'Answer with a letter.' AS content"
    " FROM conversations")
def prompt_messages(spark, d):
    """X-11, R-02: prompts with and without context."""
    c = table(spark, d, "conversations")
    m = P.messages(F.coalesce("text", F.lit("")), F.array(*[F.lit(x) for x in "1234"]), F.lit("s"), "Answer with a letter.", F.when(F.col("turn") % 2 != 0, F.col("role")))
    return c.select("conv_id", "turn", m[1]["content"].alias("content"))


_USER = "'Question: ' || {} || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'C. ' || {} || chr(10) || 'D. none' || chr(10) || chr(10) || 'Reason, then answer.'"


@query(
    "WITH ex AS (SELECT lang AS category, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, md5(text) AS question, source FROM documents),"
    f" shown AS (SELECT category, string_agg('user|' || {_USER.format('question', 'source')} || chr(1) || 'assistant|' || CASE WHEN doc_id % 2 = 0 THEN 'As in ' || source || '.' || chr(10) || '\\boxed{{' || chr(CAST(65 + doc_id % 4 AS INTEGER)) || '}}' ELSE 'Answer: ' || chr(CAST(65 + doc_id % 4 AS INTEGER)) END, chr(1) ORDER BY k) AS turns, count(*) * 2 AS n FROM ex WHERE k <= 3 GROUP BY category)"
    f" SELECT i.item_id, CAST(2 + coalesce(CASE WHEN i.item_id % 5 <> 0 THEN n END, 0) AS INTEGER) AS turns, md5('system|You know ' || coalesce(d.lang, 'all') || '.' || chr(1)"
    f" || CASE WHEN i.item_id % 5 <> 0 AND shown.turns IS NOT NULL THEN shown.turns || chr(1) ELSE '' END || 'user|' || {_USER.format('i.text', 'i.item_id')}) AS digest"
    " FROM benchmark i LEFT JOIN documents d ON d.doc_id = i.item_id AND d.lang <> 'fr' LEFT JOIN shown ON shown.category = d.lang AND i.item_id % 5 <> 0"
)
def few_shot_prompts(spark, d):
    """X-11: prompts with the examples of the question's category, three at most, each with its reasoning; every fifth question, and one without a category, has none."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").where("text is not null")
    options = lambda third: F.array(F.lit("yes"), F.lit("no"), third.cast("string"), F.lit("none"))
    letter = F.char(F.lit(65) + F.col("doc_id") % 4)
    answer = P.example_answer(letter, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("As in "), "source", F.lit("."))), True)
    first = docs.where("lang is not null").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("k <= 3")
    example = F.struct("k", F.md5("text").alias("question"), options(F.col("source")).alias("options"), answer.alias("answer"))
    bank = first.groupBy(F.col("lang").alias("category")).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    asked = items.join(docs.where("lang <> 'fr'").select("doc_id", F.col("lang").alias("category")), F.col("item_id") == F.col("doc_id"), "left").join(F.broadcast(bank), "category", "left")
    shown = F.when(F.col("item_id") % 5 != 0, F.col("examples"))
    said = P.messages(F.col("text"), options(F.col("item_id")), F.concat(F.lit("You know "), F.coalesce("category", F.lit("all")), F.lit(".")), "Reason, then answer.", examples=shown)
    whole = F.array_join(F.transform("m", lambda m: F.concat_ws("|", m["role"], m["content"])), "\x01")
    return asked.select("item_id", said.alias("m")).select("item_id", F.size("m").alias("turns"), F.md5(whole).alias("digest"))


@query(LOG + " SELECT event_id, 'tiered__qwen__zero_shot__' || CASE WHEN event_id % 3 = 0 THEN 'base' WHEN event_id % 3 = 1 THEN 'rag-mq'"
    " ELSE 'hybrid' END || '__' || strftime(ts, '%Y%m%d_%H%M%S') AS id FROM runlog")
def report_ids(spark, d):
    """F-18, D-05: ids of reports."""
    flags = F.when(F.col("event_id") % 3 == 1, F.array(F.lit("mq"), F.lit("rag"))).when(F.col("event_id") % 3 == 2,
        F.array(F.lit("hybrid"))).otherwise(F.array().cast("array<string>"))
    return runlog(spark, d).select("event_id", P.report_id(F.lit("tiered[x|y]"), T.model_slug(F.lit("org/Qwen")), F.lit("zero_shot"), flags, F.col("ts")).alias("id"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+\\z', '', 'g')"


@query(
    "WITH i AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS title, CASE WHEN doc_id % 4 > 0 THEN lang END AS headline, CASE"
        " WHEN doc_id % 5 > 0 THEN text ELSE ' ' END AS body, CASE WHEN doc_id % 7 > 0 THEN source END AS trail, CASE"
        " WHEN doc_id % 2 = 0 THEN '2026-05-17' ELSE '' END AS day FROM documents),"
    " p AS (SELECT *, coalesce(title, headline) AS t, coalesce(nullif(trim(body, ' '), ''), trail) AS x FROM i),"
    f" c AS (SELECT *, {_TRIM.format("regexp_replace(regexp_replace(CASE WHEN day <> '' THEN 'Published ' || day || '. ' ELSE '' END || trim(x, ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned"
        f" FROM p)"
    " SELECT doc_id, CASE WHEN t IS NOT NULL AND x IS NOT NULL THEN t END AS title, CASE"
        " WHEN t IS NOT NULL AND x IS NOT NULL THEN md5(cleaned) END AS digest, CASE"
        " WHEN t IS NOT NULL AND x IS NOT NULL THEN 'u/' || doc_id END AS url FROM c"
)
def news_articles(spark, d):
    """S-26, X-03: news items to articles; the title or else the headline, the body or else the trail."""
    k = F.col("doc_id")
    fields = F.struct(F.when(k % 5 > 0, F.col("text")).otherwise(" ").alias("bodyText"), F.when(k % 7 > 0, F.col("source")).alias("trailText"),
        F.when(k % 4 > 0, F.col("lang")).alias("headline"))
    item = F.struct(F.when(k % 3 > 0, F.col("source")).alias("webTitle"), F.when(k % 2 == 0, "2026-05-17T10:00:00Z").alias("webPublicationDate"),
        F.concat(F.lit("u/"), k).alias("webUrl"), fields.alias("fields"))
    return table(spark, d, "documents").select("doc_id", P.news_article(item).alias("a")).select("doc_id", "a.title", F.md5("a.text").alias("digest"), "a.url")


@query("SELECT source, CASE WHEN lang = 'en' THEN 'query: ' || source ELSE source END AS q, count(*) AS n FROM documents GROUP BY ALL")
def embedder_prefix(spark, d):
    """F-16: prefixes by model family."""
    model = F.when(F.col("lang") == "en", "org/e5-base").otherwise("org/bge-m3")
    return table(spark, d, "documents").groupBy("source", with_prefix(model, F.col("source"), "query").alias("q")).agg(F.count(F.lit(1)).alias("n"))


# An item's vector is that of its number, a document's that of its own; an item asks for the language of the document of its number.
_VECTORS = (
    ", iv AS (SELECT i.item_id AS query, i.text AS q_text, e.embedding AS qv, d.lang AS category FROM benchmark i"
        " JOIN embeddings e ON e.vec_id = i.item_id JOIN documents d ON d.doc_id = i.item_id),"
    " dv AS (SELECT d.doc_id AS doc, d.lang, e.embedding AS v FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),"
    " ds AS (SELECT query, doc, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM iv JOIN dv ON dv.lang = iv.category),"
    " de AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ds),"
    " lx AS (SELECT s.query, s.doc, row_number() OVER (PARTITION BY s.query ORDER BY round(score, 6) DESC, first_qi, s.doc) AS rank FROM s"
        " JOIN iv ON iv.query = s.query JOIN documents d ON d.doc_id = s.doc WHERE d.lang = iv.category),"
    " li AS (SELECT query, 0 AS list_id, rank, doc FROM de WHERE rank <= 25 UNION ALL SELECT query, 1, rank, doc FROM lx WHERE rank <= 25)"
)


@query(
    _HITS + _VECTORS + _FUSED.format(w="1.0")
    + f", z AS (SELECT x.query, x.key, x.rank, d.source, CASE"
        f" WHEN len(list_distinct({KEPT.format('iv.q_text')})) > 0 THEN round(len(list_intersect(list_distinct({KEPT.format('iv.q_text')}), {KEPT.format('d.text')})) / len(list_distinct({KEPT.format('iv.q_text')})), 9)"
        f" ELSE 0.0 END AS score"
    " FROM x JOIN iv USING (query) JOIN documents d ON d.doc_id = x.key WHERE x.rank <= 25),"
    " pz AS (SELECT query, key, source, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS pos FROM z),"
    " w AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY pos) > 1 AS again FROM pz)"
        ", y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY again, pos) AS place FROM w)"
    " SELECT query, key, source, score, place AS rank FROM y WHERE place <= 5"
)
def hybrid_retrieve(spark, d):
    """R-18: dense and BM25 rankings within the item's category, fused, reranked, diversified, cut."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    own = docs.select("doc_id", "lang", "source", "text")
    items = table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).join(own.select("doc_id", F.col("lang").alias("q_lang")),
        F.col("item_id") == F.col("doc_id"))
    items = items.select(F.col("item_id").alias("query"), F.col("text").alias("q_text"), F.col("embedding").alias("qv"), "q_lang")
    among = own.join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("vec"), F.col("embedding").alias("v"), "lang")
    pool = rag.pool_size(5, True, True)
    dense = R.dense(items.select("query", "qv", "q_lang"), among, pool, "lang").select("query", "rank", F.col("vec").alias("key"))
    scored = R.bm25(R.matched(own, "doc_id", "text", R.query_tokens(items, "query", "q_text"), False)).withColumn("score", F.round("score", 6))
    within = scored.join(F.broadcast(items.select("query", "q_lang")), "query").join(own.select(F.col("doc_id").alias("doc"), "lang"), "doc").where("lang = q_lang")
    lexical = R.top_k(within, pool, [F.desc("score"), F.asc("first_qi"), F.asc("doc")]).select("query", "rank", F.col("doc").alias("key"))
    return _reranked(dense, lexical, own, F.broadcast(items.select("query", "q_text")), 5)


def _reranked(dense, lexical, own, said, k):
    """The composed retrieval; the scorer needs the query's text beside its number."""
    texts = own.select(F.col("doc_id").alias("key"), "source", "text")
    keys = dense.union(lexical).select("query", "key").distinct().join(said, "query").join(texts, "key")
    sources = keys.select("key", "source", F.col("query").alias("of"), R.overlap_score(F.col("q_text"), F.col("text")).alias("overlap"))
    scores = sources.groupBy("key", "source").agg(F.map_from_entries(F.collect_list(F.struct("of", F.round("overlap", 9)))).alias("by_query"))
    return rag.retrieve(dense, lexical, scores, k, hybrid=True, rerank=True, scorer=F.col("by_query")[F.col("query")]).select("query", "key", "source", "score", "rank")


_VARIANTS = (
    "(SELECT item_id * 10 AS item_id, text FROM benchmark UNION ALL SELECT a.item_id * 10 + 1, a.text || ' ' || b.text FROM benchmark a"
        " JOIN benchmark b ON b.item_id = a.item_id + 1"
    " UNION ALL SELECT a.item_id * 10 + 2, a.text || ' ' || b.text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 2)"
)


_MULTI = (
    _HITS.replace("FROM benchmark", f"FROM {_VARIANTS}")
    + ", rk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, first_qi, doc) AS rank FROM s)"
        ", li AS (SELECT query // 10 AS query, query % 10 AS list_id, rank, doc FROM rk WHERE rank <= 15)"
    + _FUSED.format(w="1.0")
    + f", z AS (SELECT x.query, x.key, x.rank, CASE"
        f" WHEN len(list_distinct({KEPT.format('i.text')})) > 0 THEN round(len(list_intersect(list_distinct({KEPT.format('i.text')}), {KEPT.format('d.text')})) / len(list_distinct({KEPT.format('i.text')})), 9)"
        f" ELSE 0.0 END AS score"
    " FROM x JOIN benchmark i ON i.item_id = x.query JOIN documents d ON d.doc_id = x.key WHERE x.rank <= 15)"
    ", mq AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM z)"
)


@query(_MULTI + " SELECT query, key, score, place AS rank FROM mq WHERE place <= 3")
def multi_query_retrieve(spark, d):
    """R-19: a question, and the question with each option (the next two items), ranked each for itself, fused, reranked once by the question, cut."""
    return _multi_query(spark, d, 3)


def _multi_query(spark, d, k):
    b = table(spark, d, "benchmark")
    option = lambda j: b.select((F.col("item_id") - j).alias("of"), F.col("text").alias(f"o{j}"))
    asked = b.join(option(1), F.col("item_id") == F.col("of"), "left").drop("of").join(option(2), F.col("item_id") == F.col("of"), "left").drop("of")
    variants = R.multi_query(asked.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        F.array("o1", "o2").alias("options"))).where("list_id = 0 or text <> ''")
    given = asked.select(F.col("item_id").alias("question_id"), F.array(F.lit(True), F.col("o1").isNotNull(), F.col("o2").isNotNull()).alias("given"))
    variants = variants.join(given, "question_id").where(F.get("given", F.col("list_id"))).select((F.col("question_id") * 10 + F.col("list_id")).alias("variant"), "text")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    q = R.query_tokens(variants, "variant", "text")
    ranked = postings.search(postings.blocks(docs, "doc_id", "text", q, positions=False), q, 15)
    lists = ranked.select(F.floor(F.col("query") / 10).alias("query"), (F.col("query") % 10).cast("int").alias("list_id"), "rank", F.col("doc").alias("key"))
    said = F.broadcast(b.select(F.col("item_id").alias("of"), F.col("text").alias("q_text")))
    fused = R.fuse(lists, 15).join(said, F.col("query") == F.col("of")).join(docs.select(F.col("doc_id").alias("key"), "text"), "key")
    return R.rerank(fused, F.round(R.overlap_score(F.col("q_text"), F.col("text")), 9), k).select("query", "key", "score", "rank")


@query(
    _MULTI + _GOLD.replace("b.rank AS found_at FROM gold g LEFT JOIN b ON b.query = g.query AND b.doc = g.gold AND b.rank <= 20",
        "mq.place AS found_at FROM gold g LEFT JOIN mq ON mq.query = g.query AND mq.key = g.gold AND mq.place <= 10")
    + " SELECT count(*) AS n, round(avg(CASE WHEN found_at <= 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_1, round(avg(CASE WHEN found_at <= 5 THEN 1.0"
        " ELSE 0.0 END), 9) AS recall_5, round_even(avg(coalesce(1.0 / found_at, 0)), 4) AS mrr FROM fd"
)
def multi_query_recall(spark, d):
    """R-35: recall of the multi-query recipe for the documents that contain an item."""
    ranked = _multi_query(spark, d, 10).select("query", "rank", F.col("key").cast("string").alias("title"))
    found = R.title_rank(ranked, _gold(spark, d).select("query", F.col("gold").cast("string").alias("gold")))
    return recall(found, (1, 5), [])


_OPTIONS = "(SELECT item_id * 10 AS item_id, text FROM benchmark" + "".join(
    f" UNION ALL SELECT a.item_id * 10 + {j}, a.text || ' ' || b.text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + {j}" for j in (1, 2, 3, 4)) + ")"
_HYBRID = (
    _HITS.replace("FROM benchmark", f"FROM {_OPTIONS}")
    + ", rk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, first_qi, doc) AS rank FROM s),"
    f" va AS (SELECT v.item_id AS query, e.embedding AS qv FROM {_OPTIONS} v JOIN embeddings e ON e.vec_id = v.item_id // 10 + v.item_id % 10),"
    " dn AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT va.query, d.doc_id AS doc, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score"
        " FROM va, documents d JOIN embeddings e ON e.vec_id = d.doc_id)),"
    " l2 AS (SELECT query, 0 AS list_id, rank, doc FROM dn WHERE rank <= 15 UNION ALL SELECT query, 1, rank, doc FROM rk WHERE rank <= 15),"
    " f2 AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min(list_id * 1000 + rank) AS first FROM l2 GROUP BY query, doc),"
    " x2 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, first) AS rank FROM f2),"
    " li AS (SELECT query // 10 AS query, query % 10 AS list_id, rank, doc FROM x2 WHERE rank <= 15)"
)


@query(_HYBRID + _MULTI[_MULTI.index(", f AS (SELECT query, doc AS key") :] + " SELECT query, key, score, place AS rank FROM mq WHERE place <= 3")
def multi_query_hybrid(spark, d):
    """R-19: a question, and the question with each of four options, each ranked by dense search and BM25 and fused, all fused again, reranked once by the question, cut."""
    items, vectors = table(spark, d, "benchmark").where("text is not null"), table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    given = items.select(F.col("item_id").alias("other"), F.col("text").alias("option"))
    number = (F.col("other") - F.col("item_id")).cast("int")
    variants = items.select("item_id", "text").join(F.broadcast(given), F.col("other").between(F.col("item_id") + 1, F.col("item_id") + 4))
    variants = variants.select((F.col("item_id") * 10 + number).alias("query"), F.concat_ws(" ", "text", "option").alias("text")).union(items.select((F.col("item_id") * 10), "text"))
    at = F.floor(F.col("query") / 10) + F.col("query") % 10
    asked = variants.select("query", at.alias("at")).join(vectors, F.col("at") == F.col("vec_id")).select("query", F.col("embedding").alias("qv"))
    among = docs.select("doc_id").join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("vec"), F.col("embedding").alias("v"))
    near = R.dense(asked, among, 15).select("query", "rank", F.col("vec").alias("key"))
    q = R.query_tokens(variants, "query", "text")
    lexical = scan.search(docs, "doc_id", "text", q, 15).select("query", "rank", F.col("doc").alias("key"))
    each = rag.retrieve(near, lexical, docs.select(F.col("doc_id").alias("key"), "source"), 15, hybrid=True, rerank=False, spread=False)
    lists = each.select(F.floor(F.col("query") / 10).alias("query"), (F.col("query") % 10).cast("int").alias("list_id"), "rank", "key")
    said = F.broadcast(items.select(F.col("item_id").alias("of"), F.col("text").alias("q_text")))
    best = small(cut(R.fuse(lists, 15).join(said, F.col("query") == F.col("of"))))  # a few rows a query, so texts stay where they are read
    fused = best.join(docs.select(F.col("doc_id").alias("key"), "text"), "key")
    return R.rerank(fused, F.round(R.overlap_score(F.col("q_text"), F.col("text")), 9), 3).select("query", "key", "score", "rank")


_READ = "(length(context) - length(replace(context, {0}, ''))) // length({0})"


@query(
    _HITS + ", o AS (SELECT query, doc, round(score, 6) AS score, doc % 3 = 0 AS live, row_number() OVER (PARTITION BY query, doc % 3 = 0 ORDER BY round(score, 6) DESC, first_qi, doc) AS rank FROM s),"
    " t AS (SELECT query, live, max(score) AS top, count(*) AS n FROM o WHERE rank <= 5 AND (NOT live OR score >= 20) GROUP BY query, live),"
    " c AS (SELECT i.item_id AS query, f.n IS NULL OR f.top < 45 AS gated, CASE WHEN NOT (f.n IS NULL OR f.top < 45) THEN 'offline' WHEN l.n > 0 THEN 'live' ELSE 'none' END AS context_source"
        " FROM benchmark i LEFT JOIN t f ON f.query = i.item_id AND NOT f.live LEFT JOIN t l ON l.query = i.item_id AND l.live),"
    " pl AS (SELECT o.query, o.score, d.source, left(d.text, 900) AS text, CASE WHEN o.live THEN 'live' ELSE 'offline' END AS side,"
        " CASE WHEN o.live THEN row_number() OVER (PARTITION BY o.query, o.live ORDER BY o.score DESC, d.source, left(d.text, 900)) ELSE o.rank END AS rank"
        " FROM o JOIN documents d ON d.doc_id = o.doc WHERE o.rank <= 5 AND (NOT o.live OR o.score >= 20)),"
    " pe AS (SELECT pl.*, '[' || rank || '] ' || source || chr(10) || text AS entry FROM pl JOIN c ON c.query = pl.query AND c.context_source = side),"
    " u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query ORDER BY rank) <= 2000 AS used FROM pe),"
    " g AS (SELECT query, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE used), '') AS context, string_agg(source || ' ' || printf('%.4f', round_even(score, 4)) || CASE WHEN used THEN ' used' ELSE '' END, '; ' ORDER BY rank) AS trace FROM u GROUP BY query),"
    " h2 AS (SELECT c.query, gated, context_source, coalesce(context, '') AS context, coalesce(trace, '') AS trace FROM c LEFT JOIN g ON g.query = c.query)"
    f" SELECT query, gated, context_source, md5(context) AS digest, trace, CASE WHEN context <> '' THEN CAST(list_position(v, list_max(v)) - 1 AS INTEGER) END AS answer"
    f" FROM (SELECT *, [{', '.join(_READ.format(x) for x in (chr(39) + 'the' + chr(39), chr(39) + 'de' + chr(39), chr(39) + 'la' + chr(39), chr(39) + 'ch' + chr(39)))}] AS v FROM h2)"
)
def rag_answers(spark, d):
    """R-21: each item's decision with the context it was answered from, the answer of a reader that counts the options in it, and the trace of its passages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.substring("text", 1, 900).alias("text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"))
    hits = R.matched(table(spark, d, "documents"), "doc_id", "text", R.query_tokens(table(spark, d, "benchmark"), "item_id", "text"), False)
    live = (F.col("doc") % 3 == 0).alias("live")
    ranked = R.top_k(R.bm25(hits).select("query", "doc", F.round("score", 6).alias("score"), "first_qi", live), 5, [F.desc("score"), F.asc("first_qi"), F.asc("doc")], ["query", "live"]).join(docs, "doc")
    off, on = ranked.where("not live"), ranked.where("live")
    decided = rag.decide(off, on, items, F.lit(45.0), 20.0).withColumn("options", F.array(*[F.lit(x) for x in ("the", "de", "la", "ch")]))

    def reader(row):
        counts = F.transform(row["options"], lambda o: F.floor((F.char_length(row["context"]) - F.char_length(F.replace(row["context"], o, F.lit("")))) / F.char_length(o)))
        return F.when(row["context"] != "", N.let(counts, lambda c: F.array_position(c, F.array_max(c)) - 1).cast("int"))

    out = rag.answered(decided, off, on, 2000, reader, 20.0)
    told = F.transform("trace", lambda p: F.concat(p["source"], F.format_string(" %.4f", p["score"]), F.when(p["used"], " used").otherwise("")))
    return out.select("query", "gated", "context_source", F.md5("context").alias("digest"), F.array_join(told, "; ").alias("trace"), "answer")


@query(
    LOG + ", o AS (SELECT question_text, max(top_score) AS top, count(*) AS n FROM runlog WHERE event_id % 3 = 0 GROUP BY 1)"
        ", l AS (SELECT question_text, max(confidence) AS top, count(*) AS n FROM runlog WHERE event_id % 3 <> 0 AND confidence >= 0.3 GROUP BY 1),"
    " q AS (SELECT question_text, CASE WHEN min(level) <= 10 THEN 0.9 END AS tau FROM runlog GROUP BY 1)"
        ", j AS (SELECT q.question_text AS query, o.n IS NULL OR coalesce(o.top < q.tau, FALSE) AS gated, o.top AS ot, o.n AS o_n, l.top AS lt, l.n AS l_n"
        " FROM q LEFT JOIN o USING (question_text) LEFT JOIN l USING (question_text)),"
    " s AS (SELECT *, CASE WHEN NOT gated THEN 'offline' WHEN l_n > 0 THEN 'live' ELSE 'none' END AS context_source FROM j)"
        " SELECT query, gated, context_source, CASE context_source WHEN 'offline' THEN o_n WHEN 'live' THEN l_n ELSE 0 END AS n_passages,"
        " CASE context_source WHEN 'offline' THEN ot WHEN 'live' THEN lt END AS top_score FROM s"
)
def rag_decision(spark, d):
    """R-21, F-10, F-11: offline passages, else live ones over the floor, else none; each event is a passage of the one or the other kind."""
    log = runlog(spark, d)
    q = log.groupBy(F.col("question_text").alias("query")).agg(F.min("level").alias("level"))
    off = log.where("event_id % 3 = 0").select(F.col("question_text").alias("query"), F.col("event_id").alias("rank"), F.col("top_score").alias("score"))
    live = log.where("event_id % 3 <> 0").select(F.col("question_text").alias("query"), F.col("confidence").alias("score"))
    return rag.decide(off, live, q, F.when(F.col("level") <= 10, 0.9))


@query(LOG + " SELECT count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence < 0.5) AS low, round(avg(CASE"
    " WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE confidence >= 0.8), 9) AS high_acc"
    ", count(*) FILTER (WHERE confidence >= 0.8 AND NOT correct) AS overconfident FROM runlog")
def confidence_split(spark, d):
    """F-21: confident and doubtful answers."""
    high, hit = F.col("confidence") >= 0.8, F.when(F.col("correct"), 1.0).otherwise(0.0)
    return runlog(spark, d).agg(F.count_if(high).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"),
        F.round(F.avg(F.when(high, hit)), 9).alias("high_acc"), F.count_if(high & ~F.col("correct")).alias("overconfident"))


@query("SELECT doc_id, source, doc_id % 7 AS chunk_id, round_even(n_chars / 7.0, 4) AS score, md5(left(text, 200)) AS preview FROM documents")
def passage_triples(spark, d):
    """F-17, R-03: what is logged of passages."""
    p = F.array(F.struct("source", (F.col("doc_id") % 7).alias("chunk_id"), (F.col("n_chars") / F.lit(7.0)).alias("score"), "text"))
    traced = table(spark, d, "documents").select("doc_id", F.explode(P.passage_trace(p)).alias("t"))
    return traced.select("doc_id", "t.source", "t.chunk_id", "t.score", F.md5("t.text_preview").alias("preview"))


@query(
    LOG + ", lv AS (SELECT question_text AS query, event_id AS source, confidence AS score, row_number() OVER (PARTITION BY question_text"
        " ORDER BY confidence DESC, event_id) AS own, 0 AS o FROM runlog WHERE event_id % 2 = 0),"
    " fl AS (SELECT question_text AS query, event_id AS source, top_score AS score, row_number() OVER (PARTITION BY question_text"
        " ORDER BY event_id) AS own, 1 AS o FROM runlog WHERE event_id % 2 = 1),"
    " b AS (SELECT * FROM lv WHERE own <= 4 UNION ALL SELECT * FROM fl), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o, own) AS rank FROM b)"
    " SELECT query, source, CASE o WHEN 0 THEN 'live' ELSE 'offline' END AS origin, score, rank FROM r WHERE rank <= 8"
)
def merged_pool(spark, d):
    """T-05: live passages by score before offline ones."""
    log = runlog(spark, d).select(F.col("question_text").alias("query"), F.col("event_id").alias("source"), "confidence", "top_score")
    offline = R.top_k(log.where("source % 2 = 1").withColumnRenamed("top_score", "score"), 2**31 - 1, [F.asc("source")])
    return rag.merged_pool(offline, log.where("source % 2 = 0").withColumnRenamed("confidence", "score"), 4)


@query("SELECT event_id, 'a' || CASE WHEN event_id % 2 = 0 THEN 'R' ELSE 'L' END || CASE WHEN event_id % 3 = 0 THEN ' bR' ELSE '' END || ' cL' AS pairs FROM events")
def extras_merge(spark, d):
    """R-04: maps as one; the right side's values win."""
    left = F.map_from_arrays(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("L"), F.lit("L")))
    k, right = F.col("event_id"), F.lit("R")
    both = F.when((k % 2 == 0) & (k % 3 == 0), F.create_map(F.lit("a"), right, F.lit("b"), right)).when(k % 2 == 0,
        F.create_map(F.lit("a"), right)).when(k % 3 == 0, F.create_map(F.lit("b"), right))
    m = P.merged(left, both)
    shown = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(shown, " ").alias("pairs"))


@query("SELECT doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source WHEN doc_id % 3 = 0 THEN source ELSE '' END AS aliases FROM documents")
def alias_merge(spark, d):
    """J-14: articles with the aliases that redirects add."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("title"), F.when(F.col("doc_id") % 3 == 0, F.array("source")).alias("aliases"), "lang", "source")
    own = docs.where("title % 2 = 0")
    more = own.select("title", F.col("source").alias("alias")).union(own.select("title", "lang"))
    return C2.with_aliases(docs, more).select("title", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT source AS title, CASE WHEN min(doc_id) FILTER (WHERE lang = 'fr') IS NOT NULL THEN 'explicit'"
    " ELSE 'harvested' END AS origin, coalesce(min(doc_id) FILTER (WHERE lang = 'fr'), min(doc_id)) AS place FROM documents GROUP BY source")
def titles_to_fetch(spark, d):
    """U-07: explicit titles before harvested ones, each once."""
    docs = table(spark, d, "documents").select(F.col("source").alias("title"), F.col("doc_id").alias("place"), "lang")
    return C2.titles_to_fetch(docs.where("lang = 'fr'"), docs.where("lang <> 'fr'"))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' ELSE '' END AS name FROM documents WHERE lang IN ('en', 'de')")
def category_filter(spark, d):
    """F-02, J-03: a list of categories, which must be known, and their display names."""
    names = C2.display_name(F.col("lang"), {"en": "English", "fr": "Français"})
    return table(spark, d, "documents").where(C2.in_categories(F.col("lang"), ["en", "de"], ["en", "de", "es", "fr"])).select("doc_id", "lang", names.alias("name"))


@query("SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'license') OR contains(lower(text), 'été') AS hit, length(text) AS n FROM documents")
def keyword_filter(spark, d):
    """X-14: texts that contain any of some words, in any letter case."""
    return table(spark, d, "documents").select("doc_id", P.contains_any(F.col("text"), ["The ", "LICENSE", "été"]).alias("hit"), F.char_length("text").cast("bigint").alias("n"))

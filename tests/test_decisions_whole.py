"""Tiers with their answers, prompts with examples, answers with context, reports of live search and the gate, on small cases."""

from pyspark.sql import functions as F

from lantern.functions import prompts as P
from lantern.operators import decide as D
from lantern.operators import observe as O
from lantern.operators import rag


def test_tiered(spark):
    questions = spark.createDataFrame([(1, 1, "a"), (2, 7, None), (3, 12, "a"), (4, 1, "maths"), (5, 2, "a"), (6, 3, "a"), (7, 4, "a"), (8, 9, "a")], "question_id int, level int, category string")
    rows = [(1, "easy", 0, 0.3, 0.05, False), (1, "medium", 1, 0.8, 0.6, True), (2, "medium", 2, 0.3, 0.0, False), (3, "hard", 3, 0.2, 0.0, False), (4, "tools", 0, 0.1, 0.0, False), (4, "medium", 1, 0.9, 0.9, False),
        (5, "easy", 1, 0.9, 0.1, False), (6, "easy", 2, 0.1, 0.0, True), (6, "medium", 3, 0.9, 0.9, False), (7, "easy", 3, 0.4, None, False), (7, "medium", 0, 0.9, 0.9, False)]
    answers = spark.createDataFrame(rows, "question_id int, tier string, chosen_index int, confidence double, margin double, is_abstain boolean")
    got = {r.question_id: (r.chosen_index, r.tier_originally, r.tier_selected, r.escalated) for r in D.tiered(questions, answers, {"maths": "tools"}, 0.1).collect()}
    assert got == {1: (1, "easy", "medium", True), 2: (2, "medium", "medium", False), 3: (3, "hard", "hard", False), 4: (0, "tools", "tools", False),
        5: (1, "easy", "easy", False), 6: (2, "easy", "easy", False), 7: (3, "easy", "easy", False), 8: (None, "medium", "medium", False)}
    assert not any(r.escalated for r in D.tiered(questions, answers, {}, None).collect())


def test_examples_in_prompts(spark):
    kind = "array<struct<question:string,options:array<string>,answer:string>>"
    four = ["w", "x", "y", "z"]
    df = spark.createDataFrame([(1, "q", four, [("e1", four, "Answer: A"), ("e2", four, "Answer: B")], None), (2, "q", four, None, ""), (3, "q", four, [("e1", four, "A")], "known")], f"i int, question string, options array<string>, ex {kind}, context string")
    said = P.messages(F.col("question"), F.col("options"), F.lit("sys"), "Go.", F.col("context"), F.col("ex"))
    got = {r.i: [(m.role, m.content) for m in r.m] for r in df.select("i", said.alias("m")).collect()}
    turn = lambda q, extra="": f"Question: {q}\n\nOptions:\nA. w\nB. x\nC. y\nD. z\n\n{extra}Go."
    assert got[1] == [("system", "sys"), ("user", turn("e1")), ("assistant", "Answer: A"), ("user", turn("e2")), ("assistant", "Answer: B"), ("user", turn("q"))]
    assert got[2] == [("system", "sys"), ("user", turn("q"))] and got[3] == [("system", "sys"), ("user", turn("q", P.REFERENCE_LEAD + "known\n\n"))]
    both = spark.createDataFrame([("B", "Since x."), ("C", None)], "letter string, why string").select(P.example_answer(F.col("letter"), F.col("why"), True), P.example_answer(F.col("letter"), F.col("why"), False)).collect()
    assert [tuple(r) for r in both] == [("Since x.\n\\boxed{B}", "Answer: B"), ("Answer: C", "Answer: C")]


def test_answered(spark):
    off = spark.createDataFrame([(1, 1, 0.9, "s", "first"), (1, 2, 0.8, "t", "second"), (2, 1, 0.1, "s", "weak")], "query int, rank long, score double, source string, text string")
    live = spark.createDataFrame([(2, 0.5, "u", "live two"), (2, 0.7, "v", "live one"), (2, 0.1, "w", "too weak"), (1, 0.9, "u", "unused")], "query int, score double, source string, text string")
    decided = rag.decide(off, live, spark.createDataFrame([(1,), (2,), (3,)], "query int"), F.lit(0.5))
    got = {r["query"]: r for r in rag.answered(decided, off, live, 14, lambda r: F.when(r["context"] != "", F.char_length(r["context"]))).collect()}
    assert (got[1].context, got[1].answer, [(t.source, t.used) for t in got[1].trace]) == ("[1] s\nfirst", 11, [("s", True), ("t", False)])
    assert (got[2].context, [(t.source, t.score, t.used) for t in got[2].trace]) == ("[1] v\nlive one", [("v", 0.7, True), ("u", 0.5, False)])
    assert (got[3].context_source, got[3].context, got[3].answer, got[3].trace) == ("none", "", None, [])


def test_reports(spark):
    rows = [("a", "live", True, True, False, "guardian_window", 2.0, 0.9, True, 3, 0.1), ("a", "live", True, True, False, "wikipedia", 4.0, 0.5, False, 3, 0.2),
        (None, "none", True, True, True, None, None, 0.1, None, 2, 0.25), ("b", "offline", False, None, None, None, None, None, True, None, 0.9), ("b", "offline", None, None, None, None, None, None, True, 1, 0.8)]
    df = spark.createDataFrame(rows, "category string, source string, gated boolean, fired boolean, all_below boolean, provider string, live_latency double, live_top_score double, correct boolean, n_passages int, top_score double")
    r = O.live_report(df).first()
    assert (r.n, r.gated, r.fired, r.above, r.wasted, r.guardian, r.wikipedia) == (5, 3, 3, 2, 1, 1, 1)
    assert (r.latency, r.live_score, r.acc_live, r.acc_none, r.boost_pp) == (3.0, 0.7, 0.5, 0.0, 50.0)
    got = {r.category: (r.n, r.n_gated, r.gate_rate, r.acc_gated, r.acc_ungated) for r in O.gate_report(df).collect()}
    assert got == {"a": (2, 2, 1.0, 0.5, None), "unknown": (1, 1, 1.0, 0.0, None), "b": (1, 0, 0.0, None, 1.0), "all": (4, 3, 0.75, 0.333333333, 1.0)}
    assert O.live_report(df.limit(0)).first().latency is None and O.gate_report(df.limit(0)).count() == 0
    assert {r[0] for r in df.select(O.live_label(F.col("provider"))).collect()} == {"Guardian", "Wikipedia"}

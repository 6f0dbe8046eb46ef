"""The pipeline's stages: planted cases and their order."""

import random

import pytest

pytest.importorskip("lantern.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lantern.llm import simhash as S  # noqa: E402


def test_similar_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, want = [], {}
    for g in range(40):
        base = [word() for _ in range(400)]
        for c in range(6):
            w = list(base)
            if c:
                for i in rng.sample(range(400), 3):
                    w[i] = word()
            rows.append((g * 10 + c, " ".join(w)))
            want[g * 10 + c] = g * 10
        part = base[:150] + [word() for _ in range(250)]  # similarity under a quarter
        rows.append((g * 10 + 9, " ".join(part)))
        want[g * 10 + 9] = g * 10 + 9
    rows += [(1000, "A b"), (1001, "a  B"), (1002, ""), (1003, None), (None, "a b")]
    want |= {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, None: 1000}
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    assert {r.doc_id: r.component_id for r in S.similar_groups(df).collect()} == want
    kept = [r.doc_id for r in S.keep_one(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({i for i, c in want.items() if i == c}) and None in kept
    assert S.keep_one(df.limit(0)).collect() == []


def test_stages_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d).cache()
        n = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < n <= before, name
        before = n
    assert corpus_pipeline.run(spark, d).count() == before

"""Stages and operators that keep a caller's columns, whatever they are called."""

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import decontaminate, lines, mixing, simhash  # noqa: E402

TEXTS = ["one two three four five six seven\nalso", "one two three four five six seven\nother", "plain words of no use to anyone at all", "plain words of no use to anyone at all", None, ""]
ITEMS = [(1, "plain words of no use to anyone")]


def docs_with(spark, *names):
    rows = [(k, t, "en", "s", len(t or ""), *["own"] * len(names)) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in names))


@pytest.mark.parametrize("names, stage", [
    (("_mix_source", "_mix_n", "_MIX_CDF", "_mix_u", "_mix_parts"), lambda spark, d: mixing.mix(d)),
    (("_gone_id", "_GONE_ID_"), lambda spark, d: simhash.keep_one(d)),
    (("_cut_id", "_cut_of", "_cut_lines", "_kept_text"), lambda spark, d: lines.dedup(d)),
    (("_dirty_id",), lambda spark, d: decontaminate.clean(d, spark.createDataFrame(ITEMS, "item_id long, text string"))),
], ids=["mix", "keep_one", "dedup", "clean"])
def test_clash(spark, names, stage):
    plain, clash = stage(spark, docs_with(spark)), stage(spark, docs_with(spark, *names))
    own = plain.columns
    assert set(clash.columns) == {*own, *names}
    assert sorted(repr([r[c] for c in own]) for r in clash.collect()) == sorted(repr([r[c] for c in own]) for r in plain.collect())
    assert {r[n] for r in clash.collect() for n in names} <= {"own"} and clash.count()

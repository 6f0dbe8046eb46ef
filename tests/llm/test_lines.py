"""Line dedup against all pairs, and edge cases."""

import random
import re

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import lines as L  # noqa: E402


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs):
    lines = []
    for d, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[\x00-\x20]+", line) if x]
            if w:
                lines.append((-(2**62) if d is None else d, p, w))
    lines = sorted({(d, p, tuple(w)) for d, p, w in lines})
    out = set()
    for k, (d, p, w) in enumerate(lines):
        for e, q, v in lines[:k]:
            if v == w or (min(len(v), len(w)) >= L.MIN_WORDS and near(list(v), list(w))):
                first = next(((e2, q2) for e2, q2, v2 in lines if v2 == w))
                out.add((d, p, e, q, 0 if (e, q) == first else 1))
                break
    return out


def test_against_all_pairs(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([1, 4, 5, 6, 12, 40]))] for _ in range(12)]
    docs = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[i : i + 1] = [[], [rng.choice("xyz")], [w[i], rng.choice("xyz")]][kind] if len(w) > 1 or kind else ["q"]
            text.append(rng.choice([" ", "  "]).join(w))
        docs.append((d * 3, "\n".join(text)))
    docs += [(500, None), (501, ""), (502, " \n\n "), (None, "\n".join(" ".join(b) for b in base)), (503, "long " * 3000 + "x"), (504, "long " * 2999 + "y x"), (0, docs[0][1])]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, at string")
    got = {(-(2**62) if r.doc_id is None else r.doc_id, r.line_no, -(2**62) if r.kept_doc_id is None else r.kept_doc_id, r.kept_line_no, r.edits) for r in L.duplicates(df).collect()}
    assert got == plain(docs)


def test_dedup(spark):
    docs = [(1, "one two three four five\nkept", 5), (2, "one two three four six\nnew line here", 9), (3, "kept\nkept", 1), (4, None, None), (5, "", 0), (6, "kept\n\nother", 3)]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, n_chars long, _kept_text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in L.dedup(df).collect()}
    assert got == {1: (docs[0][1], 28), 2: ("new line here", 13), 4: (None, None), 5: ("", 0), 6: ("\nother", 6)}
    assert L.dedup(df).columns == df.columns
    assert L.dedup(df.limit(0)).collect() == []


def test_equal_ids_with_different_texts(spark):
    """A line that goes from one row stays in another of the same id; by the lesser hash of the text one of the two is the earlier."""
    docs = [(1, "a b\nc d"), (2, "x\na b"), (2, "keep me\nother thing"), (None, "p q\nr s"), (None, "t u\np q"), (2, "x\na b")]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got[2:] == [(1, "a b\nc d"), (2, "keep me\nother thing"), (2, "x"), (2, "x")]
    assert got[:2] in ([(-1, "p q\nr s"), (-1, "t u")], [(-1, "r s"), (-1, "t u\np q")])


def test_one_template_line(spark):
    """A line that varies in one word over a corpus: all but the first are repeats, and no task gathers them."""
    df = spark.range(20_000).selectExpr("id as doc_id", "concat('posted by user', id, ' on the great forum') as text")
    got = L.duplicates(df).selectExpr("count(*) as n", "max(kept_doc_id) as kept", "min(edits) as e", "min(doc_id) as first").first()
    assert tuple(got) == (19_999, 0, 1, 1)

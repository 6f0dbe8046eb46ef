"""Links of similar texts are those of their shingle sets."""

import random

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import simhash as S  # noqa: E402


def shingles(text, size=5):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_similarity_decides(spark):
    rng = random.Random(8)
    docs, want, alike = [], {}, []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), rng.randint(4, 17)):
            other[at] = "changed"
        a, b = 2 * k, 2 * k + 1
        docs += [(a, " ".join(words)), (b, " ".join(other))]
        one, two = shingles(docs[-2][1]), shingles(docs[-1][1])
        likeness = len(one & two) / len(one | two)
        alike.append(likeness)
        want[a], want[b] = a, a if likeness >= 0.8 else b
    assert sum(0.8 <= x < 0.86 for x in alike) > 10 and sum(0.65 < x < 0.8 for x in alike) > 30
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.similar_groups(df).collect()} == want


def test_ids_that_are_null_or_repeated(spark):
    words = [f"w{k}" for k in range(200)]
    near = " ".join(words[:-1] + ["end"])
    rows = [(None, " ".join(words)), (None, "something else altogether"), (4, near), (4, "short text here"), (9, " ".join(["start", *words]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in S.similar_groups(df).collect()) == [(0, 0), (0, 4), (4, 4), (4, 4), (9, 4)]


def test_recall_against_all_pairs(spark):
    """Documents of the table: every pair of a similarity of 0.8 or more has one component, and components are those of such pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    sets = {r.doc_id: frozenset(S.set_of(r.text, 5)[0].tolist()) for r in docs.select("doc_id", "text").collect()}
    holders, root = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s or {None}:
            holders.setdefault(x, []).append(d)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    asked = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    pairs = 0
    for a, b in asked:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            pairs += sets[a] != sets[b]
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert pairs > 3
    assert got == {d: min(e for e in sets if find(e) == find(d)) for d in sets}


@pytest.mark.parametrize("hot,rest,bucket", [(1, 4_000_000, 8192), (1, 40_000, 8192), (3, 4000, 1), (1, 0, 1)])
def test_hot_groups(spark, monkeypatch, hot, rest, bucket):
    """Large groups give what small ones do: pivots, the rest, and groups that pivots don't help."""
    monkeypatch.setattr(S, "HOT_SETS", hot)
    monkeypatch.setattr(S, "REST_HASHES", rest)
    monkeypatch.setattr(S, "HOT_BUCKET", bucket)
    rng = random.Random(6)
    docs = []
    for base in range(4):
        words = [f"w{base}_{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(30 if base < 2 else 5):
            words = list(words)
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"  # a chain: its ends aren't alike
            docs.append((len(docs), " ".join(words)))
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.similar_groups(df).collect()} == root

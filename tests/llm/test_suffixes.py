"""Suffix arrays against sorting, and removal against counting every string."""

import hashlib
import random

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import suffixes as X  # noqa: E402


def test_suffix_arrays():
    rng = random.Random(1)
    cases = [b"", b"a", b"aa", b"ab", b"ba", b"mississippi", b"graindraining", b"a" * 50, b"ab" * 40, b"\0\0a\0", bytes(range(255, -1, -1))]
    cases += [bytes(rng.choices(b"ab\0"[: rng.randint(1, 3)], k=rng.randint(1, 60))) for _ in range(1500)]
    cases += [bytes(rng.choices(range(256), k=300)) for _ in range(20)]
    for d in cases:
        assert list(X.suffix_array(d)) == sorted(range(len(d)), key=lambda i: d[i:]), d


def plain(texts, length=200):
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], []).append((d, i))
    out = [bytearray(len(t)) for t in texts]
    for at in where.values():
        if len(at) > 1:
            for d, i in at:
                out[d][i : i + length] = b"\1" * length
    return out


def digest(text, mask):
    kept = bytes(c for c, m in zip(text, mask) if not m)
    return len(text), sum(mask), bytes(mask).lstrip(b"\0").rstrip(b"\0").replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    base = [" ".join(word() for _ in range(rng.randint(40, 300))) for _ in range(14)]
    texts = ["", None, "short", "x" * 199, "y" * 200, "z" * 450, "ab" * 300, base[0], base[0], base[1] + base[1][:300]]
    for _ in range(60):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "q", word()]) + t[i + rng.randint(0, 2) :]
        a = rng.randrange(len(t))
        texts.append(rng.choice([t, t[a : a + rng.randint(150, 420)], " ".join(word() for _ in range(30)) + t[a : a + rng.choice([199, 200, 201, 230])] + word() * 20]))
    return texts


@pytest.mark.parametrize("crowd,known,verdicts,deals", [(1 << 18, 3_000_000, 6_000_000, (49, 12, 1)), (400, 3_000_000, 6_000_000, (49, 12, 1)), (400, 3_000_000, 0, (5, 1)), (900, 3_000_000, 6_000_000, (97, 30, 1)), (1 << 18, 0, 6_000_000, (49, 12, 1)), (1 << 18, 3_000_000, 0, (49, 12, 1))])
def test_against_every_string(spark, monkeypatch, crowd, known, verdicts, deals):
    monkeypatch.setattr(X, "CROWD", crowd)
    monkeypatch.setattr(X, "DEALS", deals)
    monkeypatch.setattr(X, "VERDICTS", verdicts)
    monkeypatch.setattr(X, "KNOWN", known)
    texts = corpus()
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[20], "c"), (7, texts[7], "c")]
    raw = [(t or "").encode() for _, t, _ in rows]
    want = sorted(((-1 if i is None else i), *digest(t, m)) for (i, _, _), t, m in zip(rows, raw, plain(raw)))
    got = X.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, data string")).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("often", [1, 3])
def test_hot_anchors(spark, monkeypatch, often):
    """Segments of hot anchors are dealt out by their keys; the result is the same."""
    monkeypatch.setattr(X, "HOT_ANCHOR", often)
    texts = corpus()
    raw = [(t or "").encode() for t in texts]
    want = sorted((i, *digest(t, m)) for i, (t, m) in enumerate(zip(raw, plain(raw))))
    got = X.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts=False).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_empty(spark):
    assert X.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_whole_table(spark):
    from lantern.llm.queries import op8_suffix_array_dedup

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    raw = [(r.text or "").encode() for r in docs]
    want = sorted((r.doc_id, *digest(t, m)) for r, t, m in zip(docs, raw, plain(raw)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_array_dedup(spark, d).collect()) == want


def test_filter_of_hashes(spark, monkeypatch):
    """Beyond KNOWN hashes go to tasks as bits: all are known, and few others."""
    import numpy as np

    hashes = spark.range(20_000).selectExpr("xxhash64(id) AS h")
    own = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(20_000).selectExpr("xxhash64(id, 1) AS h").collect()], np.int64).view(np.uint64)
    for known in (20_000, 0):
        monkeypatch.setattr(X, "KNOWN", known)
        has = X._knowing(hashes).value
        assert X._in(has, own).all() and X._in(has, other).mean() <= (0 if known else 0.06)


def test_only_segments_in_question_are_sent(spark):
    """What is counted needs no bytes: copies of a text send none, a text that differs in one place sends those around it."""
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefgh", k=3000)) for _ in range(5)]
    for texts, most in ((base * 4, 0), ([*base, *base, base[0][:1500] + "X" + base[0][1500:]], 4000)):
        rows = X._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        known = X._knowing(X.repeated_anchors(rows))
        sent = X._distinct_segments(rows, known, X._knowing(X.shared_sides(X._keyed(rows, known)))).selectExpr("coalesce(sum(length(body)), 0) AS n").first().n
        assert (sent > 0) == (most > 0) and sent <= most * spark.sparkContext.defaultParallelism

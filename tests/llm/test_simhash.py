"""SimHash links against all pairs, and the edge cases its docstrings state."""

import random

import numpy as np
import pytest
import xxhash

pytest.importorskip("lantern.llm")
from lantern.llm import simhash as S  # noqa: E402


def plain_fingerprint(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hs) * 2 > len(hs))


def plain_components(fps, radius):
    """fps: list of (id, fp)."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and bin(a ^ b).count("1") <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def test_fingerprint_matches_plain():
    rng = random.Random(3)
    texts = ["", None, " \n\t", "one", "One two", "A b C", "é\x1cÉ x y z", "a b c d"]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    for t in texts:
        assert S.fingerprint(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_groups_match_plain(radius):
    rng = np.random.default_rng(radius)
    sizes = np.array([1, 2, 70, 3, 200])
    fps = []
    for n in sizes:
        base = rng.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(n):
            f = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(b)
            fps.append(f)
    fps = np.array(fps, dtype=np.uint64)
    got = S.link_groups(fps, sizes, radius, at_once=500)
    at = 0
    for n in sizes:
        want = plain_components([(i, int(fps[i])) for i in range(at, at + n)], radius)
        assert {i: int(got[i]) for i in range(at, at + n)} == want
        large = S.link_large(fps[at : at + n], radius)
        assert {i: int(large[i - at]) + at for i in range(at, at + n)} == want
        at += n


@pytest.mark.parametrize("hot", [8192, 3])
def test_links_match_all_pairs(spark, hot):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                f ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                f ^= 7 << rng.randrange(60)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from lantern.llm.graph import components

    edges = S.links(spark.createDataFrame(signed, "fp long"), hot=hot)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    by = plain_components([(i, f) for i, f in enumerate(fps)], 2)
    groups = {}
    for i, r in by.items():
        groups.setdefault(r, set()).add(fps[i])
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_rows_and_edge_cases(spark):
    rows = [(5, "a b c d"), (3, "A B c D"), (3, "A B c D"), (9, ""), (7, None), (None, "q r s"), (11, "zz " * 50000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[5] == comp[3] == 3 and comp[9] == comp[7] == 7 and comp[11] == 11 and comp[None] is None
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_query_on_whole_table(spark):
    from lantern.llm.queries import op2_simhash_near_dedup

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs], 2)
    got = op2_simhash_near_dedup(spark, d).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in docs}


def test_large_groups():
    import numpy as np

    from lantern.llm import simhash as S

    rng = np.random.default_rng(5)
    for near, radius in ((0, 2), (40, 2), (300, 3)):
        base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
        copies = base[rng.integers(0, 5, near)] ^ (np.uint64(1) << rng.integers(0, 64, near).astype(np.uint64)) if near else base[:0]
        chain = np.array([(1 << k) - 1 for k in range(60)], dtype=np.uint64)  # each a bit from the next
        fps = rng.permutation(np.unique(np.concatenate([base, copies, chain])))
        want = S.link_groups(fps, np.array([len(fps)]), radius)
        assert (S.link_large(fps, radius) == want).all() and (S.link_large(fps, radius, at_once=50) == want).all()

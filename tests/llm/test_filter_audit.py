"""Filter interactions: against plain loops, collisions of hashes, edge cases and the query against its SQL."""

import re
from itertools import permutations

import duckdb
import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import filter_audit as A  # noqa: E402
from lantern.llm import queries as Q  # noqa: E402

DOCS = "doc_id long, text string, source string"


def plain_fails(docs):
    least = {}
    for i, t, _ in docs:
        least.setdefault(t or "", []).append(i)
    out = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        others = least[t]
        copy = any(o is not None and (i is None or o < i) for o in others)
        out.append((s or "", {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}, i))
    return out


def plain(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows, out = plain_fails(docs), []
    for part in {r[0] for r in rows}:
        own, shares, found = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails = [r for r in own if r[1][f]]
                shares[f] += len(gone)
                found.append((part, "".join(order), k + 1, len(left), len(gone), len(fails) - len(gone), sum(sum(r[1].values()) == 1 for r in fails),
                    sum(r[2] in good for r in gone), sum(r[2] in toxic for r in gone), f))
        out += [(*x[:-1], shares[x[-1]]) for x in found]
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [(5, LONG, "a"), (3, LONG, "b"), (9, LONG, None), (3, LONG, "b"), (None, LONG, "a"), (None, "# x", ""), (1, None, "a"), (2, "", "a"), (4, "x " * 70, "b"),
    (6, LONG.upper(), "b"), (7, LONG + " &", "a"), (8, "é ü\x0b\x1c " * 40 + LONG, "c"), (10, "a b " * 200_000, "c"), (11, LONG + " ", "c")]
LABELS = [(5, 1, 0), (3, 0, 1), (3, 1, 0), (9, 1, 1), (4, None, 1), (77, 1, 1), (None, 1, 1), (6, 0, None)]


@pytest.mark.parametrize("parts, held", [(1, 1 << 24), (5, 1 << 24), (3, 1)])
def test_plain(spark, parts, held):
    docs, labels = spark.createDataFrame(ROWS, DOCS).repartition(parts), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, A.audit(docs, labels, held=held).collect())) == plain(ROWS, LABELS)


def test_collisions_make_chains(spark):
    rows = [(k, f"text {k % 7}", "s") for k in range(200)] + [(k, "hot", "s") for k in range(500, 200, -1)]
    for held in (1, 1 << 20):
        got = {r[0]: r[2] >> 4 for r in A.masks(spark.createDataFrame(rows, DOCS).repartition(6), hashed=lambda t: len(t) % 2, held=held).collect()}
        assert got == {r[2]: int(r[1]["E"]) for r in plain_fails(rows)}


def test_hot_text_sends_few_rows():
    rows = [(k, "hot " * 100, "s") for k in range(3000)]
    sent = list(A._sent(rows, A.fingerprint, A.HELD))
    assert sum(x[1][0] is not None for x in sent) == 1 and sum(len(x[1][2]) for x in sent) == 3000


def test_edge_cases(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(*r, "m", "p", 1, 2) for r in ROWS], DOCS + ", mask string, part string, id int, flags int")
    got = A.audit(docs, labels.limit(0))
    assert sorted(map(tuple, got.collect())) == plain(ROWS, [])
    assert A.audit(docs.limit(0), labels).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = Q.op13_filter_audit(spark, d)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = c.sql(Q.oracle_sql()["op13_filter_audit"])
    assert got.columns == want.columns
    rows = sorted(repr(tuple(r)) for r in got.collect())
    assert rows == sorted(map(repr, want.fetchall())) and len(rows) % 600 == 0

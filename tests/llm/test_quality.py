"""Held-out accuracy, shrinkage, and edge cases."""

import numpy as np
import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import quality as Q  # noqa: E402


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = Q.classify(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("keep", "quality = 1 and toxic = 0 as good").collect()
    keep, good = (np.array([r[k] for r in got]) for k in (0, 1))
    assert len(got) > 1000
    assert (keep == good).mean() > 0.93, (keep == good).mean()
    assert keep[good].mean() > 0.97, keep[good].mean()


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 3.0)] * 400 + [("bad", "a", -3.0)] * 400 + [("one", "a", -3.0), (None, None, 3.0)]
    got = {r.host: r for r in Q.site_shares(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.0).collect()}
    assert got["big"].path_share > 0.9 and got["bad"].path_share < 0.1
    assert got["bad"].path_share < got["one"].path_share < 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", "s", None), (2, None, None, "en"), (2, None, None, "en"), (None, "", "s", "en"), (3, "w " * 200000, "s", "en")], "doc_id long, text string, source string, lang string").withColumn("EVIDENCE", Q.F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classify(docs, none).count() == 5
    assert Q.keep_good(docs, none).columns == docs.columns and Q.keep_good(docs, none).count() == 5
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert Q.classify(docs, labels).count() == 5
    assert Q.classify(docs.limit(0), labels).collect() == []
    kept = {tuple(r) for r in Q.keep_good(docs, labels).collect()}
    want = {r.doc_id for r in Q.classify(docs, labels).collect() if r.keep}
    assert {r[0] for r in kept} == want


def _logit(p):
    return np.log(p / (1 - p))


def plain_posteriors(rows, prior):
    """rows (host, path, evidence): the posterior of each, document by document."""
    share = lambda x: 1 / (1 + np.exp(-x))
    p = [share(e + prior) for _, _, e in rows]

    def grouped(key):
        out = {}
        for r, x in zip(rows, p):
            out.setdefault(key(r), []).append(x)
        return out

    def strength(groups, toward):
        n, m = np.array([len(g) for g in groups.values()], float), np.array([np.mean(g) for g in groups.values()])
        t = np.array([toward(k) for k in groups])
        if len(n) < 2 or n.sum() <= len(n):
            return 1e3
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values())
        noise = max(within / (n.sum() - len(n)), 1e-9)
        tau = ((n * (m - t) ** 2).sum() - (len(n) - 1) * noise) / max(n.sum() - (n * n).sum() / n.sum(), 1.0)
        middle = max((n * m * (1 - m)).sum() / n.sum(), 1e-9)
        return min(max(middle / max(tau, middle * 1e-4) - 1, 1.0), 1e4)

    mean, hosts, paths = np.mean(p), grouped(lambda r: r[0]), grouped(lambda r: r[:2])
    k_host = strength(hosts, lambda _: mean)
    shrink = lambda k, t, g: (k * t + sum(g)) / (k + len(g))
    k_path = strength(paths, lambda k: shrink(k_host, mean, hosts[k[0]]))
    out = []
    for i, (host, path, e) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        h = shrink(k_host, mean, [p[j] for j in others if rows[j][0] == host])
        s = shrink(k_path, h, [p[j] for j in others if rows[j][:2] == (host, path)])
        out.append(share(e + _logit(min(max(s, 1e-6), 1 - 1e-6))))
    return out


def test_posteriors_match_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{h}", rng.choice(["a", "b", None]), float(rng.normal(0.7 * (h - 3), 1))) for h in range(8) for _ in range(int(rng.integers(1, 30)))]
    rows += [(None, "a", 1.0), ("lone", "z", -2.0)]
    rows = [(h, None if p is None or p == "None" else str(p), e) for h, p, e in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, _q_host string, _q_path string, evidence double")
    shares = Q.site_shares(df.selectExpr("_q_host as host", "_q_path as path", "evidence"), 0.4)
    got = {r.doc_id: r.posterior for r in Q._posterior(df, shares, 0.4).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(plain_posteriors(rows, 0.4), rel=1e-9)


def test_sample_is_bounded_in_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda texts, good, kinds: seen.append(len(texts)))
    Q.fit_on(docs, labels)
    monkeypatch.setattr(Q, "FIT_CHARS", 5200)
    Q.fit_on(docs, labels)
    assert seen == [50, 10]

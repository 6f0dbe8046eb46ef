"""Quality classification with hierarchical empirical Bayes.

A logistic regression over the shape of a text and mined marker words gives
each document's own evidence.  Sites differ: grouped aggregation gives each
host, and each path within a host, a posterior share of good documents.  A
host's share is shrunk toward the global one and a path's toward its host's, by
prior strengths that the method of moments estimates from the spread between
groups; sparse sites so stay near the prior.  A document's posterior joins its
evidence, in log-odds, with the share of its path's and host's other documents:
its own evidence counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, small
from .tokens import CHUNK, DIGIT, Words, chunks, words_of

#: The classifier is fitted on at most so many labelled rows, those whose ids have the least hashes, and at most so many characters of them in all.
FIT_ROWS = 6000
FIT_CHARS = 24_000_000
KEEP = 0.5
#: Marker words of each kind of rejected documents, those that mark it most.
MARKERS = 200
#: About 3 words of a million pass this log-likelihood ratio by chance.
CHANCE = 22.0
_SIGNS = [ord(c) for c in "|!#$%&*.,;:?\n"]
_CLIP = 12.0


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    bad: np.ndarray  # sorted hashes of words that mark rejected documents
    prior: float  # log-odds of a good document in the sample


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    summed = np.concatenate([[0], np.cumsum(flags)])
    return summed[at[1:]] - summed[at[:-1]]


def shape(w: Words, bad: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    size = np.maximum(np.diff(w.text_at) - 1, 1).astype(float)
    words = np.bincount(w.text, minlength=w.n).astype(float)
    per_word, some = np.maximum(words, 1), lambda mask: np.bincount(w.text[mask], minlength=w.n)
    cols = [np.log1p(size), np.log1p(words), np.bincount(w.text, w.end - w.start, w.n) / per_word]
    for sign in _SIGNS:
        share = _per_text(w.raw == sign, w.text_at) / per_word
        cols += [np.minimum(share, 2), np.sqrt(np.minimum(share, 2))]
    cols += [some(w.shout) / per_word, some(w.upper) / per_word, some(w.kind == DIGIT) / per_word, _per_text(w.raw >= 0x80, w.text_at) / size,
        _per_text(w.raw == 32, w.text_at) / size]
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    cols.append(some(same) / per_word)
    hits = np.zeros(w.n)
    if len(bad) and len(w.hash):
        hits = some(bad[np.minimum(np.searchsorted(bad, w.hash), len(bad) - 1)] == w.hash).astype(float)
    cols += [(hits > 0).astype(float), np.log1p(hits), np.minimum(hits / per_word * 20, 3)]
    return np.column_stack(cols)


def _markers(groups: list[np.ndarray], bad: np.ndarray) -> np.ndarray:
    """Words (a hash once for each text of groups) that stand in bad texts more than twice as often as expected, by a log-likelihood ratio that chance doesn't reach."""
    hashes = np.concatenate(groups) if groups else np.empty(0, np.uint64)
    flag = np.repeat(bad, [len(g) for g in groups])
    unique, inverse = np.unique(hashes, return_inverse=True)
    in_bad, in_all = np.bincount(inverse[flag], minlength=len(unique)), np.bincount(inverse, minlength=len(unique))
    share = min(max(bad.mean(), 1e-9), 1 - 1e-9) if len(bad) else 0.5
    part = lambda n, e: n * np.log(np.maximum(n, 1) / e)
    ratio = 2 * (part(in_bad, in_all * share) + part(in_all - in_bad, in_all * (1 - share)))
    pick = np.flatnonzero((in_bad >= 4) & (in_bad > 2 * in_all * share) & (ratio >= CHANCE))
    return unique[pick[np.argsort(-ratio[pick], kind="stable")][:MARKERS]]


def _pieces(texts: list[str | None]) -> Iterator[Words]:
    """The words of some texts at a time: their arrays are many times as large as the texts."""
    held, total = [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        total += len(held[-1])
        if total >= CHUNK:
            yield words_of(held)
            held, total = [], 0
    if held:
        yield words_of(held)


def fit(texts: list[str | None], good: np.ndarray, kinds: list[np.ndarray] | None = None, ridge: float = 1.0) -> Model:
    """A ridge logistic regression by Newton steps; marker words are mined for each kind of bad texts (flags).  Fewer than two classes give a model without evidence."""
    good = np.asarray(good, dtype=bool)
    kinds = [~good] if kinds is None else kinds
    sets = []
    for w in _pieces(texts):
        edges = np.searchsorted(w.text, np.arange(w.n + 1)).tolist()
        sets += [np.unique(w.hash[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if not len(good) or good.all() or not good.any():
        width = shape(words_of([b""]), np.empty(0, np.uint64)).shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), np.empty(0, np.uint64), 0.0)
    bad = np.unique(np.concatenate([_markers(sets, k) for k in kinds]))
    del sets
    x = np.concatenate([shape(w, bad) for w in _pieces(texts)])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    y, b = good.astype(float), np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    share = y.mean()
    return Model(mean, scale, b, bad, float(np.log(share / (1 - share))))


def evidence(model: Model, w: Words) -> np.ndarray:
    """Log-likelihood ratio of good to rejected for each text: the classifier's log-odds less its sample's."""
    z = np.column_stack([np.clip((shape(w, model.bad) - model.mean) / model.scale, -8, 8), np.ones(w.n)])
    return np.clip(z @ model.weights - model.prior, -_CLIP, _CLIP)


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most rows labelled documents.  Good: quality 1 and not toxic (a null toxic is not toxic; a null quality is no label)."""
    prepare(docs.sparkSession)
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic"))
    picked = cut(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    sizes = met.select("_h", "doc_id", F.xxhash64("text").alias("_t"), F.coalesce(F.char_length("text"), F.lit(0)).alias("_n")).orderBy("_h", "doc_id", "_t").limit(rows).collect()
    kept = int(np.searchsorted(np.cumsum([r[3] for r in sizes]), FIT_CHARS, side="right")) if sizes else 0
    if kept < len(sizes):
        last = sizes[max(kept, 1) - 1]
        met = met.where(F.struct("_h", "doc_id", F.xxhash64("text").alias("_t")) <= F.struct(F.lit(last[0]).alias("_h"),
            F.lit(last[1]).alias("doc_id"), F.lit(last[2]).alias("_t")))
    got = met.select("text", "_quality", "_toxic", "doc_id", "_h").orderBy("_h", "doc_id", F.xxhash64("text")).limit(rows).select("text", "_quality", "_toxic").collect()
    texts = [r[0] for r in got]
    low, toxic = np.array([r[1] != 1 for r in got], dtype=bool), np.array([r[2] != 0 for r in got], dtype=bool)
    del got
    return fit(texts, ~(low | toxic), [low, toxic])


def scores(docs: DataFrame, model: Model, keys: list[str], inside: int | None = None) -> DataFrame:
    """keys of docs and their evidence, a double.  inside: the text is that field of the first key, a struct; else it is the column text."""
    prepare(docs.sparkSession)
    frame = docs.select(*keys) if inside is not None else docs.select(*keys, "text")
    schema = docs.select(*keys).withColumn("evidence", F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            found = [evidence(model, w) for w in chunks(b.column(len(keys)) if inside is None else b.column(0).field(inside))]
            own = pa.array(np.concatenate(found) if found else np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], own], names=[*keys, "evidence"])

    return frame.mapInArrow(run, schema)


def _share(log_odds):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _strength(groups: DataFrame, mean) -> float:
    """The prior strength (as many documents) of groups (n, s, q: rows, sum and sum of squares of shares) around mean, by the method of moments."""
    m = F.col("s") / F.col("n")
    r = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (m - mean) * (m - mean)),
        F.sum(F.col("q") - F.col("n") * m * m), F.sum(F.col("n") * m * (1 - m))).first()
    if not r[0] or r[0] < 2 or r[1] <= r[0]:
        return 1e3
    count, total, squares, between, within, spread = (float(x) for x in r)
    noise = max(within / (total - count), 1e-9)
    tau = (between - (count - 1) * noise) / max(total - squares / total, 1.0)
    middle = max(spread / total, 1e-9)
    return float(min(max(middle / max(tau, middle * 1e-4) - 1, 1.0), 1e4))


def site_shares(scored: DataFrame, prior: float) -> DataFrame:
    """scored (host, path, evidence) -> (host, path, n, s, host_n, host_s, host_share, path_share, mean, k_host, k_path): posterior shares of good documents, and what they are made of.  Null hosts and paths are groups of their own."""
    p = _share(F.col("evidence") + F.lit(prior))
    paths = cut(scored.withColumn("p", p).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    every = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = float(every[1] / every[0]) if every[0] else 0.5
    k_host = _strength(hosts, F.lit(mean)) if every[0] else 1e3
    hosts = hosts.select(F.col("host").alias("_h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"),
        _shrunk(F.lit(mean), k_host, F.col("s"), F.col("n")).alias("host_share"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    k_path = _strength(joined, F.col("host_share")) if every[0] else 1e3
    return joined.select(
        "host", "path", "n", "s", "host_n", "host_s", "host_share", _shrunk(F.col("host_share"), k_path, F.col("s"), F.col("n")).alias("path_share"),
            F.lit(mean).alias("mean"), F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path")
    )


def _shrunk(toward, strength, total, n):
    """The share of n documents with a sum of shares, shrunk toward a prior."""
    k = F.lit(strength) if isinstance(strength, float) else strength
    return (k * toward + total) / (k + n)


def _posterior(scored: DataFrame, shares: DataFrame, prior: float) -> DataFrame:
    slim = shares.select(F.col("host").alias("_h"), F.col("path").alias("_p"),
        *[F.col(c).alias(f"_s_{c}") for c in ("n", "s", "host_n", "host_s", "mean", "k_host", "k_path")], "host_share", "path_share")
    joined = scored.join(small(slim), F.col("_q_host").eqNullSafe(F.col("_h")) & F.col("_q_path").eqNullSafe(F.col("_p")))
    own = _share(F.col("evidence") + F.lit(prior))
    host = _shrunk(F.col("_s_mean"), F.col("_s_k_host"), F.greatest(F.col("_s_host_s") - own, F.lit(0.0)), F.col("_s_host_n") - 1)
    path = _shrunk(host, F.col("_s_k_path"), F.greatest(F.col("_s_s") - own, F.lit(0.0)), F.col("_s_n") - 1)
    edge = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))
    return joined.withColumn("posterior", _share(F.col("evidence") + F.log(edge / (1 - edge))))


def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", keep: float = KEEP, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, host_share, path_share, posterior, keep) of every row of docs.

    Null and empty texts are scored like any other (no words); rows that repeat
    are scored alike; without labels the evidence is 0 and the posterior the
    site's share of one half.  Other columns of docs are left out.
    """
    model = fit_on(docs, labels, rows)
    frame = docs.select("doc_id", F.col(host).cast("string").alias("_q_host"), F.col(path).cast("string").alias("_q_path"), "text")
    scored = cut(scores(frame, model, ["doc_id", "_q_host", "_q_path"]))
    shares = site_shares(scored.select(F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), "evidence"), model.prior)
    out = _posterior(scored, shares, model.prior)
    return out.select("doc_id", F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), "evidence", "host_share", "path_share", "posterior",
        (F.col("posterior") >= keep).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", keep: float = KEEP, rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that classify rejects.  Texts are scored a second time rather than shuffled to their decision."""
    model = fit_on(docs, labels, rows)
    sites = docs.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    shares = site_shares(scores(sites, model, ["host", "path"]), model.prior)
    columns = docs.columns
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_q_row"), F.col(host).cast("string").alias("_q_host"), F.col(path).cast("string").alias("_q_path"))
    found = _posterior(scores(frame, model, ["_q_row", "_q_host", "_q_path"], columns.index("text")), shares, model.prior)
    return found.where(F.col("posterior") >= keep).select("_q_row.*")

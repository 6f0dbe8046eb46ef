"""How filters act on each other: what each removes, alone, after others, and over all orders.

Exact copies are found by routing: rows go by the 64-bit xxHash of their text
to a partition, sorted, so the texts of one hash meet there as a chain of
(full text, smallest id, its rows); every row whose id isn't the smallest of its
text is a copy.  Texts are compared whole, so a collision of hashes only makes
a chain longer.  Before the shuffle a task keeps the smallest id of each text it
has seen, up to a bound of bytes, so a text sends at most a few copies from a
task, however many it has.

The other filters are bits of a mask too.  A part's rows come down to a vector
of counts by mask, merged by combineByKey, and any order of the filters is
answered from that vector.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small

#: Failure conditions, a bit each; the last is found by routing.
LETTERS = "ABCDE"
COPY = 16
MASKS = 32
#: Of a document: its bits are 0 for unlabelled, 1 for good, 2 for toxic.
FLAGS = 4
#: Bytes of text that a task holds before the shuffle.
HELD = 16 << 20
_MARK, _CAPITAL = re.compile(rb"[#$%&*|]"), re.compile(rb"[^A-Z]+")


def text_mask(text: str) -> int:
    """Bits of A (under 50 words), B (under 65 % different words), C (over 5 % capitals), D (any of #$%&*|) for a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the six white spaces of ASCII, which are the separators of the rule
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * len(_CAPITAL.sub(b"", raw)) > 5 * len(text)) << 2
        | (_MARK.search(raw) is not None) << 3
    )


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _later(a, b) -> bool:
    """a comes after b; a null id after all others."""
    return b is not None and (a is None or a > b)


class _Chains:
    """Texts of one or more hashes with the smallest id seen and that id's rows."""

    def __init__(self) -> None:
        self.by_hash: dict[int, list[list]] = {}

    def add(self, h: int, text: str, i, rows: list) -> tuple[list, bool]:
        """(rows that turn out to be copies, whether the text is new)."""
        chain = self.by_hash.setdefault(h, [])
        for link in chain:
            if link[0] == text:
                if _later(i, link[1]):
                    return rows, False
                if _later(link[1], i):
                    out, link[1], link[2] = link[2], i, list(rows)
                    return out, False
                link[2] += rows
                return [], False
        chain.append([text, i, list(rows)])
        return [], True

    def links(self) -> Iterator[tuple]:
        for h, chain in self.by_hash.items():
            for text, i, rows in chain:
                yield h, text, i, rows


def _sent(rows: Iterable, hashed: Callable[[str], int], held: int) -> Iterator[tuple]:
    """(hash, (text or None, id, [(part, mask)])): the first of each text in a task with its text; rows already known to be copies without, dealt out by id and place."""
    chains, size = _Chains(), 0
    for k, (i, text, part) in enumerate(rows):
        h = hashed(text)
        copies, new = chains.add(h, text, i, [(i, part, text_mask(text))])
        for row in copies:
            yield xxhash.xxh64_intdigest(f"{row[0]}:{k}"), (None, row[0], [(row[0], row[1], row[2] | COPY)])
        size += len(text) * new
        if size > held:
            for h_, *link in chains.links():
                yield h_, tuple(link)
            chains, size = _Chains(), 0
    for h_, *link in chains.links():
        yield h_, tuple(link)


def _judged(sent: Iterable[tuple]) -> Iterator[tuple]:
    """(id, part, mask) of every row, from a partition sorted by hash: the chain of one hash is held at a time."""
    chains, last = _Chains(), None
    for h, (text, i, rows) in sent:
        if h != last:
            for link in chains.links():
                yield from link[3]
            chains, last = _Chains(), h
        if text is None:
            yield from rows
            continue
        copies, _ = chains.add(h, text, i, rows)
        for row in copies:
            yield row[0], row[1], row[2] | COPY
    for link in chains.links():
        yield from link[3]


def masks(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "source", partitions: int | None = None,
          hashed: Callable[[str], int] = fingerprint, held: int = HELD) -> RDD:
    """(id, part, mask) of every row of docs; bit k of the mask is set if the row fails filter k of LETTERS.

    A null text counts as empty, and a null part as the empty string.  Rows that
    repeat an id and its text aren't copies of each other, but of a smaller id;
    a null id comes after all others.  Other columns aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit(""))).rdd
    sent = rows.mapPartitions(lambda it: _sent(it, hashed, held))
    return sent.repartitionAndSortWithinPartitions(n, lambda h: h % n).mapPartitions(_judged)


# ---------------------------------------------------------------- counts


def _at(code: tuple[int, int]) -> np.ndarray:
    v = np.zeros((MASKS, FLAGS), np.int64)
    v[code] = 1
    return v


def _plus(v: np.ndarray, code: tuple[int, int]) -> np.ndarray:
    v[code] += 1
    return v


def vectors(judged: RDD, labels: DataFrame, id_col: str = "doc_id") -> RDD:
    """(part, counts by mask and flags).  A document is good, or toxic, if any row of labels with its id says so."""
    rows = labels.sparkSession.createDataFrame(judged, "id long, part string, mask int", verifySchema=False)
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("flags"))
    known = rows.join(small(said), F.col("id") == F.col("l_id"), "left").select("part", "mask", F.coalesce("flags", F.lit(0)).alias("flags"))
    return known.rdd.map(lambda r: (r[0], (r[1], r[2]))).combineByKey(_at, _plus, np.add)


def _orders(n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Orders of n filters; for each order, step and mask: whether the step removes it, and whether it stands after it."""
    names = ["".join(p) for p in permutations(LETTERS[:n])]
    removed, kept = (np.zeros((len(names), n, MASKS), np.int64) for _ in range(2))
    for o, name in enumerate(names):
        alive = np.ones(MASKS, np.int64)
        for k, letter in enumerate(name):
            fails = np.arange(MASKS) >> LETTERS.index(letter) & 1
            removed[o, k] = alive * fails
            alive = alive * (1 - fails)
            kept[o, k] = alive
    return names, removed, kept


def interactions(counts: RDD) -> RDD:
    """(part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step."""

    def run(it):
        names, removed, kept = _orders(len(LETTERS))
        bits = np.arange(MASKS)
        for part, v in it:
            n, good, toxic = v.sum(1), v[:, 1] + v[:, 3], v[:, 2] + v[:, 3]
            out, stay, lost, hurt = removed @ n, kept @ n, removed @ good, removed @ toxic
            fails = [int(n[bits >> f & 1 == 1].sum()) for f in range(len(LETTERS))]
            alone = [int(n[1 << f]) for f in range(len(LETTERS))]
            shares = [0] * len(LETTERS)
            for o, name in enumerate(names):
                for k, letter in enumerate(name):
                    shares[LETTERS.index(letter)] += int(out[o, k])
            for o, name in enumerate(names):
                for k, letter in enumerate(name):
                    f = LETTERS.index(letter)
                    yield (part, name, k + 1, int(stay[o, k]), int(out[o, k]), fails[f] - int(out[o, k]), alone[f], int(lost[o, k]), int(hurt[o, k]), shares[f])

    return counts.mapPartitions(run)


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "source", **settings) -> DataFrame:
    """The filters' counts for each part, order and step (settings as for masks()).

    Every part of docs has all 120 orders of five steps, zeros included; an
    empty docs gives no rows.  Labels of other documents and null ids count
    nowhere; an empty labels gives no good and no toxic documents.
    """
    found = interactions(vectors(masks(docs, id_col=id_col, text=text, part=part, **settings), labels, id_col))
    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return docs.sparkSession.createDataFrame(found, f"part string, filter_order string, step int, {longs}")

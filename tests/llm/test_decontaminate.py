"""Template matches against a plain version, and planted passages."""

import random
import re

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import decontaminate as D  # noqa: E402


def plain_words(text):
    out = []
    for m in re.finditer(r"\d(?:[\d.,]*\d)?|[^\W\d_]+", text or ""):
        out.append(m.group())
    return out


def plain_pairs(docs, items, cover=0.8):
    def windows(text):
        words = plain_words(text)
        kind = []
        for k, w in enumerate(words):
            if w[0].isdigit():
                kind.append("<n>")
            elif w.lower() in D.UNITS and k and words[k - 1][0].isdigit():
                kind.append("<u>")
            elif w[0].isupper() and not (len(w) > 1 and w[1].isupper()):
                kind.append("<c>")
            else:
                kind.append(None)
        size = 5 if len(words) >= 5 else len(words)
        out = []
        for p in range(len(words) - size + 1 if words else 0):
            own = list(zip(words[p : p + size], kind[p : p + size]))
            few = sum(k is None for _, k in own) < 3
            shape = (size, few, tuple(w.lower() if few or k is None else k for w, k in own))
            out.append((p, shape, tuple(w.lower() for w, k in own if k and not few)))
        return out

    found = set()
    wanted = {i: windows(t) for i, t in items}
    for d, t in docs:
        own = windows(t)
        for i, w in wanted.items():
            runs = {}
            for p, s, v in own:
                for q, s2, v2 in w:
                    if s == s2:
                        hit, maps = runs.setdefault(p - q, (set(), set()))
                        hit.add(q)
                        maps |= set(zip(v2, v))
            hit = set()
            for h, maps in runs.values():
                if len({a for a, _ in maps}) == len(maps) == len({b for _, b in maps}):
                    hit |= h
            if w and len(hit) / len(w) >= cover:
                found.add((d, i, len(hit), len(w)))
    return found


def test_against_plain(spark):
    rng = random.Random(11)
    vocab = "the of Anna bob Carl 12 3.5 km river walks slowly over 7 kg apples Éva sur été NASA x".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 4, 5, 9, 30])))) for i in range(25)]
    docs = []
    for d in range(60):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 8, 80])))
        if d % 2:
            text += ". " + rng.choice(items)[1]
        docs.append((d, text.replace(" 12 ", " 99 ") if d % 4 == 1 else text))
    docs += [(100, None), (101, ""), (102, "filler " * 30000 + items[5][1])]
    got = D.matches(spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, hash string"), spark.createDataFrame([*items, (77, None)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.windows) for r in got} == plain_pairs(docs, items)


def test_planted(spark):
    item = "A train leaves Rome at 40 km per hour and Anna counts 12 bridges before she reaches the old town of Pisa"
    docs = [
        (1, "Some text before. " + item + " and some after."),
        (2, item.replace("Rome", "Oslo").replace("40", "85").replace("Anna", "Boris").replace("12", "7").replace("Pisa", "Bergen")),
        (3, item.replace("Anna", "Rome")),  # two names became one: not one to one
        (4, "A clean text that has nothing to do with trains or bridges at all."),
        (None, item),
    ]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in D.matches(df, bench).collect()} == {1, 2, None}
    assert {r.doc_id for r in D.clean(df, bench).collect()} == {3, 4, None}
    assert D.matches(df.limit(0), bench).collect() == [] and D.clean(df, bench.limit(0)).count() == 5


def test_without_filter(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_HASHES", 0)
    test_planted(spark)

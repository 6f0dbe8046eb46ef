"""Copies of items that templates of capitalised words alone don't find."""

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import decontaminate as D  # noqa: E402

TRAIN = "A train leaves Rome at 40 km per hour and Anna counts 12 bridges before she reaches the old town of Pisa"


def tables(spark, docs, items):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def left(spark, docs, *items):
    return sorted(r.doc_id for r in D.clean(*tables(spark, docs, items)).collect())


def test_letter_case(spark):
    other = TRAIN.replace("40", "85").replace("12", "7")
    docs = ["Before. " + TRAIN.lower() + " after", TRAIN.upper(), TRAIN.title(), TRAIN.swapcase(), other.lower(), other.upper(), TRAIN, "a clean text about old towns and bridges over the river"]
    assert left(spark, docs, TRAIN) == [7]
    assert left(spark, [TRAIN, other], TRAIN.lower()) == []
    short = "Éva saw Oslo"
    assert left(spark, [short.lower(), short.upper(), short.lower() + " again"], short) == [2]
    sharp = "Die Straße am großen Fluss ist im Winter weiß und still"
    assert left(spark, [sharp.upper(), sharp.lower()], sharp) == []


DENSE = [
    ("A train travels 60 km in 2 hours. How far does it travel in 5 hours?", "A train travels 75 km in 3 hours. How far does it travel in 8 hours?"),
    ("A shop sells 12 kg of rice for 30 dollars and 5 kg of beans for 20 dollars. What is the price of 1 kg?", "A shop sells 14 kg of rice for 35 dollars and 6 kg of beans for 24 dollars. What is the price of 3 kg?"),
    ("Tom buys 4 pens at 3 dollars each and 2 books at 7 dollars each. How much does Tom pay?", "Eva buys 5 pens at 6 dollars each and 9 books at 8 dollars each. How much does Eva pay?"),
    ("Maria runs 5 km on Monday, 7 km on Tuesday and 9 km on Friday. How many km does Maria run in total?", "Petra runs 4 km on Sunday, 6 km on Thursday and 8 km on Saturday. How many km does Petra run in total?"),
]


@pytest.mark.parametrize("hashes", [D.FILTER_HASHES, 0])
def test_dense_windows(spark, monkeypatch, hashes):
    monkeypatch.setattr(D, "FILTER_HASHES", hashes)
    docs = ["Here it comes: " + other + " And the text goes on." for _, other in DENSE]
    docs.append("Numbers 1 2 3 4 5 6 7 8 9 and Names Anna Bob Carl " * 50 + "do not make an item of a table")
    assert left(spark, docs, *[item for item, _ in DENSE]) == [4]


def test_windows_that_agree(spark):
    item = TRAIN + " while Anna still keeps the list of all 12 bridges in a small red book that lies open on the table of the slow train"
    at = item.rindex("Anna")
    one_name = item[:at] + "Clara" + item[at + 4 :]
    one_number = item.replace("all 12", "all 13")
    other = item.replace("Rome", "Oslo").replace("Anna", "Boris").replace("40", "85").replace("Pisa", "Bergen")
    docs = [one_name, one_number, other.replace("all 12", "all 19"), one_name.replace("Clara", "Rome"), other.replace("Bergen", "Boris")]
    docs.append("Anna and Rome and Anna and Pisa meet Boris in Rome")
    assert left(spark, docs, item) == [5]


def test_agreeing_is_one_to_one():
    assert D.agreeing(None) is None
    held = [(0, [(1, 2)], [0]), (1, [(1, 2)], [3]), (2, [(1, 3)], [6]), (3, [(4, 2)], [8]), (4, [(5, 5)], [9]), (5, [], [])]
    assert D.agreeing(held) == [0, 1, 4, 5]


NAMES = "The old painter Anna Maria Lopez lives in New York City and sells small maps of the harbour to Boris near the river market"


@pytest.mark.parametrize("hashes", [D.FILTER_HASHES, 0])
def test_names_of_other_lengths(spark, monkeypatch, hashes):
    monkeypatch.setattr(D, "FILTER_HASHES", hashes)
    other = NAMES.replace("Anna Maria Lopez", "Eva").replace("New York City", "Oslo").replace("Boris", "Karl Heinz")
    longer = NAMES.replace("Boris", "Jean Paul Michel Andre")
    clean = "The old painter Eva paints in Oslo while small ships leave the harbour for Karl Heinz and his market"
    assert left(spark, [f"So: {other} and more.", longer, clean, other.replace("small maps of the harbour", "large nets from a boat")], NAMES) == [2, 3]


def test_recall_on_reparameterised_items(spark):
    """Every item of the benchmark with its names and numbers changed, within other text: nine tenths are found, and no text of other items."""
    import random
    import re

    rng = random.Random(4)
    d = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    names = ["Eva", "Karl Heinz", "Oslo", "Quito", "Nia Bela", "Tomas", "Uppsala", "Zora"]

    def changed(text):
        seen = {}
        return re.sub(r"\b(?:[A-Z][a-zà-ÿ]+|\d+)\b", lambda m: seen.setdefault(m[0], str(rng.randrange(1000, 9999)) if m[0].isdigit() else rng.choice(names) + rng.choice("abcdef") * rng.randint(2, 5)), text)

    filler = [" ".join(f"filler{rng.randrange(10**5)}" for _ in range(60)) for _ in items]
    docs = [(r.item_id, f"{a} {changed(r.text)} {a}") for r, a in zip(items, filler)] + [(10_000 + k, a) for k, a in enumerate(filler)]
    found = {r.doc_id for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{d}/benchmark.parquet")).where("doc_id = item_id or doc_id >= 10000").collect()}
    assert not any(k >= 10_000 for k in found) and len(found) >= 0.9 * len(items)

"""Benchmark decontamination by canonical templates.

Words become a template: numbers, names (capitalised words) and units after a
number are typed placeholders, other words are lower-cased.  Windows of five
template words are hash-joined with those of the benchmark's items.  The values
that stood in the placeholders must map one to one between item and document
along a match, so a question with other numbers or names is caught and chance
meetings of placeholders are not.  A window with fewer than three plain words
says too little as a template and is compared by its words as they are.

That is matches().  leaks() is the whole job: letter case decides what is a
name, so it compares every window also by its lower-cased words, and by a
template in which only numbers and units are placeholders.  A window with fewer
than three plain words is widened, once to its right and once to its left, until
it has three.  As names differ in their number of words, windows are also
compared with each run of capitalised words as one placeholder; such a window
stands for all windows of five words in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, prepare, small
from .tokens import DIGIT, Words, chunks, mix, powers, windows, words_of

#: Units that a number may carry.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l cl liter liters litre litres gallon gallons pint pints s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "c f k degree degrees percent pct usd eur gbp dollar dollars euro euros cent cents w kw kwh v a hz khz mhz ghz j kj n pa mph kmh"
).split()
WINDOW, PLAIN, COVER = 5, 3, 0.8
#: Distinct window hashes of the benchmark up to which they go to every task as a filter (8 bytes each); beyond, all windows are shuffled.
FILTER_HASHES = 2_000_000
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x11, 0x22, 0x33))
_SCHEMA = pa.schema([("id", pa.int64()), ("pos", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())),
    ("n", pa.int64()), ("cell", pa.int64())])
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_BACK = pow(_BASE, -1, 1 << 64)
_LEFT, _RUNS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)
#: A window's cell is its first word's position times this, plus how many windows of WINDOW words it holds besides the first.
_CELL = 1024


def _unit_hashes() -> np.ndarray:
    return np.sort(words_of([u.encode() for u in UNITS]).hash)


def _kinds(w: Words, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are numbers, units after a number, and names."""
    number = w.kind == DIGIT
    follows = np.concatenate([[False], number[:-1] & (w.text[1:] == w.text[:-1])])
    k = np.minimum(np.searchsorted(units, w.hash), len(units) - 1)
    unit = follows & (units[k] == w.hash)
    return number, unit, w.upper & ~w.shout & ~unit & ~number


def template_windows(w: Words, units: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """text, position in the text, hash and number of the text's windows, of each window (only those whose hash is in the sorted array only); its slots: values, how many, and their words' positions in the text; and its cell.

    A text of fewer than WINDOW words is one window; a text without words has none.
    """
    if not len(w.hash):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), none, np.empty(0, np.uint64), none, none, none
    number, unit, name = _kinds(w, units)
    slot = number | unit | name
    shape = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, w.hash)))
    counts = w.counts()
    begin = np.cumsum(counts) - counts
    out = []
    full = counts >= WINDOW
    if len(w.hash) >= WINDOW:
        template, plain = windows(mix(shape), WINDOW), windows(w.hash, WINDOW)
        slots = np.concatenate([[0], np.cumsum(slot)])
        few = (WINDOW - (slots[WINDOW:] - slots[:-WINDOW])) < PLAIN
        h = np.where(few, plain, template)
        at = np.arange(len(h))
        inside = w.text[at] == w.text[at + WINDOW - 1]
        if only is not None:
            inside &= only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
        at = at[inside]
        out.append((w.text[at], at - begin[w.text[at]], h[at], counts[w.text[at]] - WINDOW + 1, np.full(len(at), WINDOW), few[at]))
    short = np.flatnonzero(~full & (counts > 0))
    if len(short):
        h = np.empty(len(short), np.uint64)
        few = np.empty(len(short), bool)
        for i, t in enumerate(short.tolist()):
            s = slice(begin[t], begin[t] + counts[t])
            few[i] = counts[t] - slot[s].sum() < PLAIN
            h[i] = windows(w.hash[s] if few[i] else mix(shape[s]), int(counts[t]))[0] ^ np.uint64(counts[t])
        keep = np.ones(len(short), bool) if only is None else only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
        out.append((short[keep], np.zeros(keep.sum(), np.int64), h[keep], np.ones(keep.sum(), np.int64), counts[short[keep]], few[keep]))
    text, pos, h, n, size, few = (np.concatenate(x) for x in zip(*out, strict=True))
    where = begin[text] + pos
    at = np.repeat(where - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    open_slot = slot[at] & ~np.repeat(few, size)
    held = np.add.reduceat(open_slot, np.cumsum(size) - size) if len(size) else np.empty(0, np.int64)
    held = held.astype(np.int64)
    return text, pos, h, n, w.hash[at[open_slot]], held, at[open_slot] - np.repeat(begin[text], held), pos * _CELL


def whole_windows(w: Words, units: np.ndarray, only: np.ndarray | None = None, widest: int | None = None) -> tuple[np.ndarray, ...]:
    """What template_windows gives, of each window's lower-cased words, its template, and its template without names where these differ.

    A template of fewer than PLAIN plain words has the words to its right (left) up to the one that makes them PLAIN, or isn't there if the text ends before.
    Windows of over widest words are left out.
    """
    if not len(w.hash):
        return template_windows(w, units, only)
    counts = w.counts()
    begin = np.cumsum(counts) - counts
    at = np.flatnonzero(np.arange(len(w.hash)) - begin[w.text] <= np.maximum(counts[w.text] - WINDOW, 0))
    size = np.minimum(counts[w.text[at]], WINDOW)
    up, down = powers(_BASE, len(w.hash)), powers(_BACK, len(w.hash) + 1)
    out = []

    def add(values: np.ndarray, slot: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.uint64 = np.uint64(0)) -> None:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up)])
        h = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64)) ^ salt
        if only is not None:
            keep = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
            at, start, size, h = at[keep], start[keep], size[keep], h[keep]
        word = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        open_slot = slot[word]
        held = np.add.reduceat(open_slot, np.cumsum(size) - size, dtype=np.int64) if len(size) else np.empty(0, np.int64)
        text = w.text[at]
        out.append((text, at - begin[text], h, np.maximum(counts[text] - WINDOW + 1, 1), w.hash[word[open_slot]], held,
            word[open_slot] - np.repeat(begin[text], held), (at - begin[text]) * _CELL))

    number, unit, name = _kinds(w, units)
    add(w.hash, np.zeros(len(w.hash), bool), at, at, size)
    for slot, blind in ((number | unit | name, False), (number | unit, True)):
        shape = mix(np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(slot, _NAME, w.hash))))
        slots = np.concatenate([[0], np.cumsum(slot)])
        names = np.concatenate([[0], np.cumsum(name)])
        held = slots[at + size] - slots[at]
        new = (held > 0) & (size - held >= PLAIN) & ((names[at + size] > names[at]) | (not blind))
        add(shape, slot, at[new], at[new], size[new])
        dense, plain = at[(size - held < PLAIN) & (counts[w.text[at]] >= WINDOW)], np.flatnonzero(~slot)
        if len(plain) < PLAIN or not len(dense):
            continue
        for salt in (np.uint64(0), _LEFT):
            if salt:
                last = np.searchsorted(plain, dense + WINDOW) - PLAIN
                start, end = plain[np.maximum(last, 0)], dense + WINDOW
                own = (last >= 0) & (w.text[start] == w.text[dense])
            else:
                third = np.searchsorted(plain, dense) + PLAIN - 1
                start, end = dense, plain[np.minimum(third, len(plain) - 1)] + 1
                own = (third < len(plain)) & (w.text[end - 1] == w.text[dense])
            if widest is not None:
                own &= end - start <= widest
            own[own] &= (names[end[own]] > names[start[own]]) | (not blind)
            add(shape, slot, dense[own], start[own], (end - start)[own], salt)
    out.append(_by_name_runs(w, number, unit, name, begin, counts, only))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_name_runs(w: Words, number: np.ndarray, unit: np.ndarray, name: np.ndarray, begin: np.ndarray, counts: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """What whole_windows gives, of windows with a name in which a run of capitalised words is one; positions count such runs once."""
    first = np.ones(len(w.hash), bool)
    first[1:] = ~(name[1:] & name[:-1] & (w.text[1:] == w.text[:-1]))
    head = np.flatnonzero(first)
    end = np.append(head[1:], len(w.hash))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * powers(_BASE, len(w.hash)))])
    value = np.where(end - head > 1, mix((sums[end] - sums[head]) * powers(_BACK, len(w.hash) + 1)[head] + (end - head).astype(np.uint64)), w.hash[head])
    kinds = [x[head] for x in (number, unit, name)]
    slot = kinds[0] | kinds[1] | kinds[2]
    h = windows(mix(np.where(kinds[0], _NUMBER, np.where(kinds[1], _UNIT, np.where(kinds[2], _NAME, w.hash[head])))), WINDOW) ^ _RUNS
    at = np.arange(len(h))
    slots, names = (np.concatenate([[0], np.cumsum(x)]) for x in (slot, kinds[2]))
    last = at + WINDOW - 1
    keep = (w.text[head[at]] == w.text[head[last]]) & (names[at + WINDOW] > names[at]) & (WINDOW - (slots[at + WINDOW] - slots[at]) >= PLAIN)
    if only is not None:
        keep &= only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
    at, last, h = at[keep], last[keep], h[keep]
    text = w.text[head[at]]
    cell = (head[at] - begin[text]) * _CELL + np.minimum(end[last] - head[at] - WINDOW, _CELL - 1)
    token = (at[:, None] + np.arange(WINDOW)).ravel()
    open_slot = slot[token]
    held = open_slot.reshape(-1, WINDOW).sum(axis=1).astype(np.int64)
    places = head[token[open_slot]] - np.repeat(begin[text], held)
    return text, at - np.searchsorted(head, begin[text]), h, np.maximum(counts[text] - WINDOW + 1, 1), value[token[open_slot]], held, places, cell


def _windows_table(df: DataFrame, id_col: str, text_col: str, only: np.ndarray | None = None, of=template_windows, widest: int | None = None) -> DataFrame:
    units = _unit_hashes()

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for w in chunks(b.column(1)):
                text, pos, h, n, values, held, places, cell = of(w, units, only) if widest is None else of(w, units, only, widest)
                offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
                slots, places = (pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64))) for x in (values, places))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + w.first)), pa.array(pos), pa.array(h.view(np.int64)), slots, places,
                    pa.array(n), pa.array(cell)], schema=_SCHEMA)

    text = F.col(text_col)
    if of is whole_windows:  # in upper case sharp s is two letters
        text = F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("SS"))
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(run,
        "id long, pos long, hash long, slots array<long>, places array<long>, n long, cell long")


def agreeing(held: list | None) -> list[int] | None:
    """Cells of a run's windows that are verbatim or agree with its one-to-one mapping of most item words; of pairs with as many words, equal values come first."""
    if held is None:
        return None
    votes: dict[tuple[int, int], set[int]] = {}
    for _, slots, places in held:
        for (a, b), place in zip(slots, places, strict=True):
            votes.setdefault((a, b), set()).add(place)
    to, back = {}, {}
    for a, b in sorted(votes, key=lambda p: (-len(votes[p]), p[0] != p[1], p)):
        if a not in to and b not in back:
            to[a], back[b] = b, a
    return sorted({cell for cell, slots, _ in held if all(a == b for a, b in slots) or all(to.get(a) == b for a, b in slots)})


def matches(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, of=template_windows) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage): pairs where at least cover of the item's windows occur in the document with consistent slots.

    An item of fewer than WINDOW words is one window and is found only in a
    text with just those words; items and documents without words (null, empty)
    are in no pair.  Rows with equal ids count as one document or item; rows
    with a null doc_id are one document, items with a null item_id are left out.
    A text is read whole however long it is.  Empty tables give no pairs; other
    columns, whatever their names, are left out.
    """
    prepare(docs.sparkSession)
    items = cut(_windows_table(benchmark.where("item_id is not null"), "item_id", "text", of=of))
    n_hashes = items.select("hash").distinct().count()
    only = None
    if n_hashes <= FILTER_HASHES:
        only = np.sort(np.array([r[0] for r in items.select("hash").distinct().toLocalIterator()], dtype=np.int64).view(np.uint64))
        if not len(only):
            only = np.zeros(1, np.uint64)
    widest = None
    if only is None and of is whole_windows:  # a wider window is in no item
        widest = (items.agg(F.max("n")).first()[0] or 0) + WINDOW - 1
    found = _windows_table(docs, "doc_id", "text", only, of, widest).select(F.col("id").alias("doc_id"), "pos", "hash", "slots")
    wanted = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("hash").alias("item_hash"), F.col("slots").alias("item_slots"), "places", "cell")
    pairs = found.join(wanted, (F.col("hash") == F.col("item_hash")) & (F.size("slots") == F.size("item_slots")))
    pairs = pairs.select("doc_id", "item_id", "cell", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("slots"), "places")
    found_in = [F.collect_set("cell").alias("hit"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("map")]
    if of is whole_windows:
        found_in.append(F.collect_list(F.struct("cell", "slots", "places")).alias("held"))
    runs = pairs.groupBy("doc_id", "item_id", "shift").agg(*found_in)
    one_to_one = (F.size("map") == F.size(F.array_distinct(F.transform("map",
        lambda s: s["a"])))) & (F.size("map") == F.size(F.array_distinct(F.transform("map", lambda s: s["b"]))))
    if of is whole_windows:
        agreed = F.udf(agreeing, "array<long>")(F.when(~one_to_one, F.col("held")))
        runs = runs.select("doc_id", "item_id", F.coalesce(agreed, "hit").alias("hit"))
    else:
        runs = runs.where(one_to_one)
    cells = runs.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("cells"))
    sizes = items.groupBy(F.col("id").alias("of")).agg(F.max("n").alias("windows"))
    sized = cells.join(sizes, F.col("item_id") == F.col("of"))
    covered = F.flatten(F.transform("cells", lambda c: F.sequence(F.floor(c / _CELL),
        F.least(F.floor(c / _CELL) + c % _CELL, F.greatest(F.floor(c / _CELL), F.col("windows") - 1)))))
    hits = sized.withColumn("matched", F.size(F.array_distinct(covered)).cast("long"))
    joined = hits.select("doc_id", "item_id", "matched", "windows", (F.col("matched") / F.col("windows")).alias("coverage"))
    return joined.where(F.col("coverage") >= cover)


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """What matches gives, with an item's window also found where only its letter case differs, or that of its names, and with few plain words by the words around it.

    Where a run of windows isn't one to one as a whole, those that agree with its mapping count.
    """
    return matches(docs, benchmark, cover, whole_windows)


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """docs without the rows whose doc_id is in a pair; rows with a null doc_id stay."""
    name = free_name(docs, "_dirty_id")
    dirty = cut(leaks(docs, benchmark, cover).where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small(dirty), F.col("doc_id") == F.col(name), "left_anti")

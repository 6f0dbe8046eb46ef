"""Document fingerprints from closed syncmers, in DataFrame functions only.

A window of K units (words; longer ones are cut into pieces) is chosen if the
least of its inner runs of S units stands at either edge.  Whether a window is
chosen depends on its own units alone, so two texts choose the same anchors
wherever they agree, whatever surrounds them, and whatever their lengths.  A
sketch is the anchors of least hash (all of a text with few) in the order of
the text.  Two sketches are matched by position: the anchors that both have
count, less one for each place where the one's order breaks off in the other,
so scattered meetings count for little and runs of agreement for much.

Every text has a sketch of words.  A short one has few words, so it has a second
sketch, of characters, kept apart: two short texts are compared by that, and any
other two by their words, so only like is compared with like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

K, S, SIZE = 3, 1, 64
#: Texts of at most so many code points have a sketch of characters too, by windows of CHAR_K and runs of CHAR_S.
SHORT, CHAR_K, CHAR_S = 256, 4, 2
#: A unit is a word or a piece of one, of at most so many characters.
PIECE = 16
#: Rows with neighbouring ids meet in one window frame: so many ids at least, more where that gives over STRETCHES frames.
STRETCH, STRETCHES = 64, 500_000


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from(array: Column, i: int) -> Column:
    """array from its i-th element on, counted from 0."""
    return array if i == 0 else F.slice(array, F.lit(i + 1), F.size(array))


def units(text: Column, piece: int = PIECE) -> Column:
    """A lower-cased text's words, those of over piece characters in pieces."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[^\x00-\x20]{{1,{piece}}}"), F.lit(0))


def _windows(hashes: Column, k: int, s: int) -> Column:
    """Closed syncmers of an array of k hashes or more: a hash of each chosen window, in order."""
    n, inner = F.size(hashes) - (k - 1), k - s  # windows; runs after a window's first

    def rolled(h: Column) -> Column:
        runs = h if s == 1 else reduce(lambda a, j: F.zip_with(a, F.slice(_from(h, j), F.lit(1), F.size(h) - (s - 1)), lambda x, y: F.xxhash64(x, y)),
            range(1, s), F.slice(h, F.lit(1), F.size(h) - (s - 1)))
        shifted = lambda r, j: F.slice(_from(r, j), F.lit(1), n).alias(f"r{j}")
        own = [F.slice(_from(h, j), F.lit(1), n).alias(f"u{j}") for j in range(k)] if s > 1 else []
        return _let(runs, lambda r: F.arrays_zip(*[shifted(r, j) for j in range(inner + 1)], *own))

    middle = [f"r{j}" for j in range(1, inner)]

    def chosen(w: Column) -> Column:
        least = w[middle[0]] if len(middle) == 1 else F.least(*[w[m] for m in middle])
        return (w["r0"] <= least) | (w[f"r{inner}"] <= least)

    units_of = [f"u{j}" for j in range(k)] if s > 1 else [f"r{j}" for j in range(k)]
    return F.transform(F.filter(_let(hashes, rolled), chosen) if middle else _let(hashes, rolled), lambda w: F.xxhash64(*[w[u] for u in units_of]))


def anchors(text: Column, k: int = K, s: int = S, piece: int = PIECE) -> Column:
    """The hashes of a text's closed syncmers, in order; fewer than k units are one anchor, none have none."""
    few = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    hashed = F.transform(units(text, piece), lambda u: F.xxhash64(u))
    return _let(hashed, lambda h: F.when(F.size(h) < k, few(h)).otherwise(_windows(h, k, s)))


def _least(found: Column, size: int) -> Column:
    """The size least of the hashes, as 32-bit numbers in the order of their first places."""
    numbers = F.array_distinct(F.transform(found, lambda h: F.shiftrightunsigned(h, 32)))
    return _let(numbers, lambda d: F.when(F.size(d) <= size, d).otherwise(_let(F.get(F.sort_array(d), F.lit(size - 1)), lambda last: F.filter(d, lambda h: h <= last))))


def sketch(text: Column, size: int = SIZE, k: int = K, s: int = S, short: int = SHORT) -> Column:
    """struct<words, chars>: the anchors of least hash of each kind; chars is empty for texts of over short code points.  A null text is an empty one."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.when(F.char_length(whole) <= short, _least(anchors(whole, CHAR_K, CHAR_S, 1), size)).otherwise(F.array().cast("array<bigint>"))
    return F.struct(_least(anchors(whole, k, s), size).alias("words"), chars.alias("chars"))


def as_text(fingerprint: Column) -> Column:
    """8 hex digits a number: those of words, a dot, those of characters."""
    digits = lambda a: F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")
    return F.concat(digits(fingerprint["words"]), F.lit("."), digits(fingerprint["chars"]))


def _breaks(common: Column, other: Column) -> Column:
    """How often numbers that follow one another in common don't in other."""
    at = F.transform(common, lambda h: F.array_position(other, h))
    return _let(at, lambda p: F.size(F.filter(F.zip_with(p, _from(p, 1), lambda x, y: y < x), lambda d: d)))


def matched(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of two sketches' least size numbers that both have, less the breaks of order between these (of either in the other, whichever are more).  Two empty sketches: 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)

    def of(least: Column) -> Column:
        top = F.get(least, F.size(least) - 1)
        same = lambda x, y: F.filter(F.array_intersect(x, y), lambda h: h <= top)
        run = F.size(same(a, b)) - F.greatest(_breaks(same(a, b), b), _breaks(same(b, a), a))
        return F.greatest(run, F.lit(0)) / F.size(least).cast("double")

    return F.when(a == b, F.lit(1.0)).otherwise(_let(union, of))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """How much of two fingerprints is matched, from 0 to 1: by characters if both are of short texts with some, else by words."""
    both = (F.size(a["chars"]) > 0) & (F.size(b["chars"]) > 0)
    return F.when(both, matched(a["chars"], b["chars"], size)).otherwise(matched(a["words"], b["words"], size))


def _stretch(rows: DataFrame, key: str) -> int:
    """How many neighbouring ids make a stretch; where most rows would be in few of so many stretches, as ids are uneven, STRETCH."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    wide = -(-(high - low + 1) // STRETCHES) if n else 1
    if wide <= STRETCH:
        return STRETCH
    most = rows.groupBy(F.floor(F.col(key) / wide)).count().agg(F.max("count")).first()[0]
    return wide if most <= 16 * (n // STRETCHES + STRETCH) else STRETCH


def with_next(rows: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None, stretch: int | None = None) -> DataFrame:
    """rows with next_<column>: that of the row after it by key (null first), then by the columns; after the last comes the first.  Derived columns are added to rows and have a next one too.

    Rows are dealt by stretches of the key, and the first row of each stretch is
    also sent to the stretch before it, so no frame holds more than a stretch
    and no task sees all rows.  Rows with equal keys are in one stretch.
    """
    stretch = stretch or _stretch(rows, key)
    part = F.coalesce(F.floor(F.col(key) / stretch), F.lit(-(2**62))).cast("long")
    cut_up = rows.withColumn("_part", part)
    slim = cut(cut_up.select("_part", key).groupBy("_part").agg(F.min(key).alias("_least")))
    n = slim.count()
    before = _before(slim.select("_part"), n)
    firsts = slim.join(small(before, n), "_part").select("_part", "_least", "_before")
    heads = cut_up.join(small(firsts.withColumnRenamed("_part", "_p"), n), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_least")))
    heads = heads.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_before").alias("_part"), F.lit(1).alias("_sent"), F.col("_part").alias("_own"))
    both = cut_up.select(*[F.col(f"`{c}`") for c in rows.columns], "_part", F.lit(0).alias("_sent"), F.col("_part").alias("_own")).unionByName(heads)
    for c, value in (derived or {}).items():
        both = both.withColumn(c, value)
    order = [F.col("_sent"), F.col(key).asc_nulls_first(), *[F.col(c) for c in columns]]
    w = Window.partitionBy("_part").orderBy(*order)
    for c in [*columns, *(derived or {})]:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("_sent = 0").drop("_part", "_sent", "_own")


def _before(parts: DataFrame, n: int, fan: int = 4096) -> DataFrame:
    """(_part, _before): the part before each, and the last before the first.  Large sets are ordered by stretches of parts, and those in turn."""
    up = parts.withColumn("_up", F.floor(F.col("_part") / fan).cast("long"))
    if n <= 4 * fan:
        every = Window.partitionBy(F.lit(0)).orderBy("_part")
        last = parts.agg(F.max("_part").alias("m"))
        return parts.select("_part", F.coalesce(F.lag("_part").over(every), last.scalar()).alias("_before"))
    tops = cut(up.groupBy("_up").agg(F.max("_part").alias("_last")))
    m = tops.count()
    above = _before(tops.select(F.col("_up").alias("_part")), m, fan).select(F.col("_part").alias("_up"), F.col("_before").alias("_above"))
    last = above.join(tops.select(F.col("_up").alias("_above"), "_last"), "_above").select("_up", "_last")
    own = Window.partitionBy("_up").orderBy("_part")
    return up.withColumn("_lag", F.lag("_part").over(own)).join(small(last, m), "_up").select("_part", F.coalesce("_lag", "_last").alias("_before"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text's last quarter (floor of the code points) is replaced by as
    many code points from the start of the next row's text, by ascending id.
    A null text is empty; a null id comes first; rows with equal ids follow one
    another by their text; a single row is its own next, an empty docs gives no
    rows.  Long texts are read whole; other columns of docs are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    got = with_next(rows, "doc_id", ["text"], {"marks": sketch(F.col("text"))})
    n = F.char_length("text").cast("long")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 4) as int))"))
    edited = F.when(tail == 0, F.col("text")).otherwise(edited)
    got = got.withColumn("edited", edited).withColumn("edited_marks", sketch(F.col("edited")))
    return got.select(
        "doc_id", n.alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )

"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as their words, in order.  Equal lines meet by their hash.
Lines of MIN_WORDS words or more also meet if one edit (a word replaced, put in
or left out) turns one into the other: every line's variants with one word left
out are emitted as hashed keys and equal variants are joined.  Two lines of one
length that share a variant and the place of the gap differ there alone, and a
line that equals another's variant lacks just that word; so the earliest line
of a key stands for the whole key and no pairs within it are made.  Earliest
lines are minima that tasks take before the shuffle, so a line that varies in
one word over all the corpus gathers in no task.  Before, a
filter that loses nothing keeps the lines that share their first or second
half with another: with one edit, one half stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, free_name, small

MIN_WORDS = 5
_BREAK = "\n"


def line_words(line: Column) -> Column:
    """What stands between characters up to U+0020; most lines have only spaces, for which no regular expression is needed."""
    parts = F.when(line.rlike(r"[\x00-\x1f]"), F.split(line, r"[\x00-\x20]+")).otherwise(F.split(line, " "))
    return F.array_remove(parts, "")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, of, plain, lines): of is a hash of the text, by which rows of one id are told apart; plain texts have no white space but single spaces and line breaks, seen once for all lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = ~F.contains(text, F.lit("  ")) & ~text.rlike(r"[\x00-\x09\x0b-\x1f]")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), plain.alias("plain"), F.split(text, _BREAK).alias("lines"))


def _joined(line: Column, plain: Column) -> Column:
    """The line's words with single spaces between them."""
    return F.when(plain, F.trim(line)).otherwise(F.array_join(line_words(line), " "))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, of, pos, joined, h1, h2) of each line with words: its words with single spaces, and hashes of these."""
    rows = _texts(docs).select("doc_id", "of", "plain", F.posexplode("lines").alias("pos", "line"))
    own = rows.select("doc_id", "of", "pos", _joined(F.col("line"), F.col("plain")).alias("joined")).where("joined <> ''")
    return own.withColumn("h1", F.xxhash64("joined")).withColumn("h2", F.xxhash64(F.lit(7), "joined"))


def _halves(words: Column, n: Column) -> Column:
    """The keys a line has among lines of n words and among lines of n - 1 words: of the half before the edit, or after it."""
    out = []
    for less in (0, 1):
        m = n - less
        h = F.floor(m / 2).cast("int")
        out += [F.xxhash64(m, F.lit(0), F.slice(words, F.lit(1), h)), F.xxhash64(m, F.lit(1), F.slice(words, h + less + 1, m - h))]
    return F.array(*out)


def _place(*cols: str) -> Column:
    """A line's place; places are in the order of doc_id, hash of the text and line."""
    return F.struct(*[F.col(c).alias(a) for c, a in zip(cols, ("doc_id", "of", "pos"), strict=True)])


def _own_place() -> Column:
    return _place("doc_id", "of", "pos")


def _at(place: str, doc: str, of: str, pos: str) -> Column:
    """Whether a place is that of the columns."""
    return F.col(f"{place}.doc_id").eqNullSafe(F.col(doc)) & (F.col(f"{place}.of") == F.col(of)) & (F.col(f"{place}.pos") == F.col(pos))


def _distinct(rows: DataFrame) -> DataFrame:
    """Each distinct line: hashes, how many there are, the earliest's place, and its halves' keys."""
    split = rows.withColumn("words", F.split("joined", " "))
    n = F.size("words")
    hashed = split.select("h1", "h2", _own_place().alias("at"), F.when(n >= MIN_WORDS, _halves(F.col("words"), n)).alias("keys"))
    return hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))


def _candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, of, pos, before, after): lines that share a half with a line they may be one edit from; whether the edit may lie in the first or in the second half."""
    keyed = lines.where(F.col("keys").isNotNull()).select("at", F.posexplode("keys").alias("slot", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("slot") < 2, 1).otherwise(0)).alias("own"))
    shared = shared.where("`all` > 1 and own > 0").select(F.col("key").alias("k"))
    met = keyed.join(shared, F.col("key") == F.col("k"))
    return met.groupBy("at.doc_id", "at.of", "at.pos").agg(F.max(F.col("slot") % 2 == 1).alias("before"), F.max(F.col("slot") % 2 == 0).alias("after"))


def _with_hashes(docs: DataFrame, found: DataFrame, n_found: int) -> DataFrame:
    """found with the hashes of each line's words."""
    wanted = found.groupBy(F.col("doc_id").alias("w_doc"), F.col("of").alias("w_of")).agg(F.collect_list(F.struct("pos", "before", "after")).alias("wanted"))
    joined = _texts(docs).join(F.broadcast(wanted) if n_found <= BROADCAST_ROWS else wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("of") == F.col("w_of")))
    each = joined.select("doc_id", "of", "plain", "lines", F.explode("wanted").alias("w")).select("doc_id", "of", "w.*",
        _joined(F.get("lines", F.col("w.pos")), F.col("plain")).alias("joined"))
    hashes = F.transform(F.split("joined", " "), lambda w: F.xxhash64(w))
    return each.select("doc_id", "of", "pos", "before", "after", hashes.alias("words")).dropDuplicates(["doc_id", "of", "pos"])


def _variants(lines: DataFrame) -> DataFrame:
    """(key, gap, at): each line's variants with a word left out where an edit may lie, and the line itself (gap -1)."""
    n = F.size("words")
    first = F.when(F.col("before"), F.lit(0)).otherwise(F.floor((n - 1) / 2).cast("int"))
    last = F.when(F.col("after"), n - 1).otherwise(F.floor(n / 2).cast("int"))
    gaps = F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("gap"), F.xxhash64(n - 1, F.slice("words", F.lit(1), i), F.slice("words", i + 2, n)).alias("key")))
    own = F.array(F.struct(F.lit(-1).alias("gap"), F.xxhash64(n, "words").alias("key")))
    return lines.where(n >= MIN_WORDS).select(_own_place().alias("at"), F.explode(F.concat(own, gaps)).alias("v")).select("v.key", "v.gap", "at")


def _met(variants: DataFrame) -> DataFrame:
    """(at, kept): lines that share a key with an earlier one, and the earliest of it: of the lines with the key as a variant, at the same gap; and of those that are the key."""
    whole, gapped = (F.min(F.when(c, F.col("at"))) for c in (F.col("gap") < 0, F.col("gap") >= 0))
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), whole.alias("whole"), gapped.alias("gapped")).where("n > 1").withColumnRenamed("key", "k")
    shared = cut(shared)
    met = cut(variants.join(small(shared), F.col("key") == F.col("k")).select("key", "gap", "at", "whole", "gapped"))
    least = met.where("gap >= 0").groupBy(F.col("key").alias("l_key"), F.col("gap").alias("l_gap")).agg(F.min("at").alias("least"))
    joined = met.join(least, (F.col("key") == F.col("l_key")) & (F.col("gap") == F.col("l_gap")), "left")
    earlier = F.when(F.col("gap") < 0, F.array("gapped")).otherwise(F.array("least", "whole"))
    return joined.select("at", F.explode(earlier).alias("kept")).where(F.col("kept") < F.col("at")).distinct()


def _one_edit(a: Column, b: Column) -> Column:
    """Whether the word lists are at edit distance 1 or less."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= 1

    def lacks(short: Column, long: Column) -> Column:
        same = F.coalesce(F.array_position(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x != y), True).cast("int"), F.lit(0))
        gap = F.when(same == 0, F.size(short)).otherwise(same - 1)
        return F.slice(short, gap + 1, F.size(short)) == F.slice(long, gap + 2, F.size(long))

    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) == F.size(b) + 1, lacks(b, a)).when(F.size(b) == F.size(a) + 1, lacks(a, b)).otherwise(False)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(at, near): the earliest line each line of pairs is truly one edit from."""
    a, b = (lines.select(F.col("doc_id").alias(x + "_doc"), F.col("of").alias(x + "_of"), F.col("pos").alias(x + "_pos"), F.col("words").alias(x)) for x in "ab")
    joined = pairs.join(a, _at("at", "a_doc", "a_of", "a_pos")).join(b, _at("kept", "b_doc", "b_of", "b_pos"))
    return joined.where(_one_edit(F.col("a"), F.col("b"))).groupBy("at").agg(F.min("kept").alias("near"))


def _repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, of, pos, kept, edits): each line that repeats an earlier one, and the place of the earliest it repeats."""
    lines = cut(_distinct(_lines(docs)))
    found = cut(_candidates(lines))
    hashed = cut(_with_hashes(docs, found, found.count()))
    near = _verified(cut(_met(_variants(hashed))), hashed).select(F.col("at.doc_id").alias("n_doc"), F.col("at.of").alias("n_of"), F.col("at.pos").alias("n_pos"), "near")
    repeats = lines.join(near, _at("at", "n_doc", "n_of", "n_pos"), "left").where("copies > 1 or near is not null")
    repeats = cut(repeats.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "at", F.least("at", "near").alias("kept")))
    same = (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))
    joined = _lines(docs).drop("joined").join(small(repeats), same).where(F.col("kept") < _own_place())
    return joined.select("doc_id", "of", "pos", "kept", F.when(F.col("kept") == F.col("at"), 0).otherwise(1).alias("edits"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, edits): each line that repeats an earlier one, and the earliest it repeats.

    Earlier: by doc_id (null first), then by the line's number from 0; of rows
    with equal ids and different texts, those whose text has the lesser hash.  A
    line is a repeat if an earlier one has the same words (edits 0), or has one
    edit (1) and both have MIN_WORDS words or more, however long they are;
    whether that one itself is a repeat doesn't matter.  Lines without words, so
    null and empty texts, are never repeats.  Rows with equal ids and texts are
    one document.  Other columns of docs are left out.
    """
    found = _repeats(docs)
    return found.select("doc_id", F.col("pos").cast("long").alias("line_no"), F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.pos").cast("long").alias("kept_line_no"), "edits")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the lines that duplicates names; rows that so lose their last word are left out, rows that had none stay.

    A column n_chars, if there, is set to the new text's length in code points.
    """
    gone_id, gone_of, gone_lines, kept = (free_name(docs, x) for x in ("_cut_id", "_cut_of", "_cut_lines", "_kept_text"))
    removed = cut(_repeats(docs).groupBy(F.col("doc_id").alias(gone_id), F.col("of").alias(gone_of)).agg(F.collect_set("pos").alias(gone_lines)))
    size = removed.agg(F.coalesce(F.sum(F.size(gone_lines)), F.lit(0))).first()[0]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(gone_of))
    joined = docs.join(F.broadcast(removed) if size <= BROADCAST_ROWS else removed, same, "left")
    left = F.filter(F.split("text", _BREAK), lambda line, i: ~F.array_contains(gone_lines, i))
    joined = joined.withColumn(kept, F.when(F.col(gone_lines).isNull(), F.col("text")).otherwise(F.array_join(left, _BREAK)))
    joined = joined.where(F.col(gone_lines).isNull() | F.col(kept).rlike(r"[^\x00-\x20]"))
    own = [F.col(kept).alias(c) if c == "text" else F.char_length(kept).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own)

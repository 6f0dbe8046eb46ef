"""Corpus operators: keep-first dedup, append, chunking, projections for the indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..shared import cut, small, spread


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order.  A minimum of the order is pre-aggregated, so a hot key isn't gathered."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    at = F.struct(*[F.col(f"l.{o}").alias(o) for o in order]) == F.col("r._first")
    cond = at
    for s in same:
        cond = s & cond
    return df.alias("l").join(first.alias("r"), cond, "left_semi")


def append_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of incoming, the first of each key, whose key is not in existing."""
    return keep_first(incoming, [key], order).join(existing.select(key).distinct(), key, "left_anti")


def resolve_titles(titles: DataFrame, normalized: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, resolved): through the normalisation and then the redirect of each title, if any."""
    n = normalized.select(F.col("from").alias("n_from"), F.col("to").alias("n_to"))
    r = redirects.select(F.col("from").alias("r_from"), F.col("to").alias("r_to"))
    step = titles.join(n, F.col("title") == F.col("n_from"), "left").withColumn("via", F.coalesce("n_to", "title"))
    return step.join(r, F.col("via") == F.col("r_from"), "left").select("title", F.coalesce("r_to", "via").alias("resolved"))


def fixed_windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping word windows: array<struct<chunk_id, text>>; the last is the first to reach the end."""
    stride = max(1, size - overlap)
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride))).cast("int")
    return F.when(n == 0, F.array().cast("array<struct<chunk_id:int,text:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_id"), F.array_join(F.slice(words, i * stride + 1, F.lit(size)), " ").alias("text")))
    )


def pack(sentences: Column, size: int, overlap: int) -> Column:
    """Greedy packing of sentences into windows of at most size words, each beginning with the overlap of the one before; longer sentences are cut into windows.

    Windows are ranges of the text's words: the fold goes over the sentences'
    lengths and moves two numbers, and words are taken once, at its end.
    """
    stride = max(1, size - overlap)
    kind = "array<struct<a:int,b:int>>"
    window = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def flushed(acc):
        return F.when(acc["e"] >= acc["s"], F.concat(acc["out"], F.array(window(acc["s"], acc["e"])))).otherwise(acc["out"])

    def state(s, e, out):
        return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), out.cast(kind).alias("out"))

    def step(acc, n):
        s, e = acc["s"], acc["e"]
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride))).cast("int")
        own = F.transform(F.sequence(F.lit(0), last), lambda i: window(e + 1 + i * stride, F.least(e + size + i * stride, e + n)))
        long = state(F.greatest(e + 1 + last * stride, e + n - (overlap - 1)), e + n, F.concat(flushed(acc), own))
        over = state(F.greatest(s, e - (overlap - 1)), e + n, F.concat(acc["out"], F.array(window(s, e))))
        return F.when(n > size, long).when(e - s + 1 + n > size, over).otherwise(state(s, e + n, acc["out"]))

    def ranges(x):
        start = state(F.lit(1), F.lit(0), F.array().cast(kind))
        return F.transform(F.aggregate(x["sizes"], start, step, flushed), lambda r: F.slice(x["words"], r["a"], r["b"] - r["a"] + 1))

    split = N.let(F.transform(sentences, T.words), lambda w: F.struct(F.flatten(w).alias("words"), F.transform(w, F.size).alias("sizes")))
    return N.let(split, ranges)


def merge_short(chunks: Column, least: int) -> Column:
    """array<string>: chunks of fewer than least words join the one before; the first stays."""
    def step(acc, c):
        short = (T.word_count(c) < least) & (F.size(acc) > 0)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), c)))
        return F.when(short, joined).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(chunks, F.array().cast("array<string>"), step)


def chunk(articles: DataFrame, size: int = 300, overlap: int = 50, least: int | None = None) -> DataFrame:
    """Articles (source, text, ...) to chunks: text, chunk_id, section_title, is_lead, with the articles' other columns; aliases stay on lead chunks only.

    Sections and sentences bound the windows; a section's header precedes its
    first chunk; a chunk under least words (size // 5) joins its predecessor.
    """
    least = max(1, size // 5) if least is None else least
    articles = spread(articles)
    parts = F.transform(
        T.sections("text"),
        lambda s, i: F.transform(
            pack(T.sentences(s["body"]), size, overlap),
            lambda w, j: F.struct(
                F.concat(F.when((j == 0) & (s["header"] != ""), F.concat(s["header"], F.lit("\n"))).otherwise(""), F.array_join(w, " ")).alias("text"),
                F.nullif(s["header"], F.lit("")).alias("section_title"), ((i == 0) & (s["header"] == "")).alias("is_lead"),
            ),
        ),
    )

    def groups(every: Column) -> Column:
        """Each chunk that isn't short, with the short ones up to the next."""
        starts = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: (i == 0) | ~((T.word_count(F.get(every, i)["text"]) < least) & F.lit(least > 1)))
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(every)))

        def joined(a: Column, b: Column) -> Column:
            own = F.transform(F.slice(every, a + 1, b - a), lambda c: c["text"])
            return F.struct(F.array_join(own, " ").alias("text"), F.get(every, a)["section_title"].alias("section_title"), F.get(every, a)["is_lead"].alias("is_lead"))

        return F.zip_with(starts, ends, joined)

    none = F.array().cast("array<struct<text:string,section_title:string,is_lead:boolean>>")
    merged = N.let(F.flatten(parts), lambda e: F.when(F.size(e) > 0, groups(e)).otherwise(none))
    others = [c for c in articles.columns if c not in ("text", "aliases")]
    out = articles.withColumn("_chunks", merged).select(*others, *(["aliases"] if "aliases" in articles.columns else []), F.posexplode("_chunks").alias("chunk_id", "_c"))
    own = [*others, "chunk_id", "_c.*"]
    return out.select(*own, *([F.when(F.col("_c.is_lead"), F.col("aliases")).alias("aliases")] if "aliases" in articles.columns else []))


def embedding_text(source: Column, aliases: Column, section: Column, text: Column) -> Column:
    """'source (also known as: a; b) - section: text' with what there is; the text alone without a source."""
    title = F.trim(F.coalesce(source, F.lit("")))
    known = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (also known as: "), F.array_join(aliases, "; "), F.lit(")"))).otherwise("")
    part = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" — "), section)).otherwise("")
    return F.when(title == "", text).otherwise(F.concat(title, known, part, F.lit(": "), text))


def surface_text(text: Column, aliases: Column) -> Column:
    return F.concat_ws(" ", text, F.array_join(aliases, " "))


# Query and passage prefixes by model family, the more specific first.
PREFIXES = (("bge-m3", "", ""), ("e5", "query: ", "passage: "), ("bge", "Represent this sentence for searching relevant passages: ", ""))


def with_prefix(model: Column, text: Column, side: str) -> Column:
    out = F.when(F.lit(False), text)
    for family, query, passage in PREFIXES:
        out = out.when(F.lower(model).contains(family), F.concat(F.lit(query if side == "query" else passage), text))
    return out.otherwise(text)


#: Steps after which the nodes of a walk are put together again.
_STEPS = 8


def closure(edges: DataFrame, seeds: list[str], depth: int) -> DataFrame:
    """(node, depth) reached from seeds along edges (parent, child) within depth steps, each at its least depth.

    Semi-naive: a step joins only the nodes that the last one found, and ends the
    walk if it finds none.  Each step's nodes are checkpointed, and all of them
    put together every few steps, so a plan has a bounded number of relations
    however deep the walk is.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("parent is not null and child is not null").select("parent", "child").distinct())
    front = cut(spark.createDataFrame([(s, 0) for s in dict.fromkeys(seeds)], "node string, depth int"))
    parts = [front]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.union, parts).select("node")
        step = edges.join(small(front.select("node")), F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > _STEPS:
            parts = [cut(reduce(DataFrame.union, parts))]
    return reduce(DataFrame.union, parts)


def top_by_priority(df: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of each key's least priority: the first source that gave anything."""
    w = Window.partitionBy(key)
    return df.withColumn("_least", F.min(priority).over(w)).where(F.col(priority) == F.col("_least")).drop("_least")


def with_aliases(articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """articles with the aliases (title, alias) of their titles added to their own, each once, in alphabetical order."""
    own = aliases.where("alias <> ''").groupBy("title").agg(F.collect_set("alias").alias("_more"))
    none = F.array().cast("array<string>")
    return articles.join(own, "title", "left").withColumn("aliases", F.sort_array(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("_more", none))))).drop("_more")


def titles_to_fetch(explicit: DataFrame, harvested: DataFrame) -> DataFrame:
    """(title, origin, place) of both, each title once, the explicit ones first, each in its own order (place)."""
    both = explicit.select("title", "place", F.lit(0).alias("o")).union(harvested.select("title", "place", F.lit(1)))
    firsts = both.groupBy("title").agg(F.min(F.struct("o", "place")).alias("f"))
    return firsts.select("title", F.when(F.col("f.o") == 0, "explicit").otherwise("harvested").alias("origin"), F.col("f.place").alias("place"))


def display_name(category: Column, names: dict[str, str]) -> Column:
    """A category's display name, '' for others."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.lit(""))


def in_categories(category: Column, wanted: list[str], known: list[str]) -> Column:
    """Whether a category is one of wanted; a wanted one that isn't known is an error."""
    strange = sorted(set(wanted) - set(known))
    if strange:
        raise ValueError(f"unknown categories: {', '.join(strange)}")
    return category.isin(wanted)


def gap_phrases(gaps: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, n, first_event) of candidate titles in the questions of gaps (event_id, question_text, options) that known (title) lacks, whatever the letter case: how often each is asked for, and the spelling of its first event."""
    rows = gaps.select("event_id", F.posexplode(T.candidate_phrases(F.col("question_text"), F.col("options"))).alias("pos", "phrase"))
    counted = rows.groupBy(F.lower("phrase").alias("_key")).agg(F.min(F.struct("event_id", "pos", "phrase")).alias("f"), F.count(F.lit(1)).alias("n"))
    have = known.select(F.lower("title").alias("_key")).distinct()
    return counted.join(have, "_key", "left_anti").select(F.col("f.phrase").alias("phrase"), "n", F.col("f.event_id").alias("first_event"))

"""Queries over the corpus: text functions, dedup, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..shared import spread
from .common import query, table

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: Tokens of a text in DuckDB.
TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+')"
KEPT = "list_filter(" + TOK + f", lambda t: t NOT IN ({_STOP}))"


@query(f"SELECT lang, count(*) AS docs, CAST(sum(len({TOK.format('text')})) AS BIGINT) AS tokens"
    f", CAST(sum(len({KEPT.format('text')})) AS BIGINT) AS kept FROM documents GROUP BY lang")
def tokenize_counts(spark, d):
    """X-01: tokens with and without stopwords, by language."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"),
        F.sum(F.size(T.tokens(F.col("text"), False))).alias("tokens"), F.sum(F.size(T.tokens(F.col("text")))).alias("kept"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({KEPT.format('text')}) AS token FROM documents)"
    f" GROUP BY token HAVING count(DISTINCT doc_id) >= 3")
def stopword_filter(spark, d):
    """X-01, A-21: frequencies of tokens that are left, in three documents or more."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    by_doc = rows.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return by_doc.groupBy("token").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs")).where("docs >= 3")


#: Articles from documents: citations after sentences, a heading where a line breaks, and a tail on every third.
_ART_SQL = (
    "(SELECT doc_id, replace(replace(coalesce(text, ''), '. ', '. [' || doc_id % 40 || '] '), chr(10), chr(10) || '== Part ' || source || ' ==' || chr(10))"
    " || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '=== See also ===' || chr(10) || 'list' || chr(10) || '== More ==' || chr(10) || 'x'"
        " ELSE chr(10) || '== Empty ==' || chr(10) || chr(10) || '== Last ==' || chr(10) || 'End.' END AS text FROM documents)"
)


def _articles(spark, d):
    k, line = F.col("doc_id"), F.lit("\n")
    cited = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.concat(F.lit(". ["), k % 40, F.lit("] ")))
    headed = F.replace(cited, line, F.concat(F.lit("\n== Part "), F.col("source"), F.lit(" ==\n")))
    tail = F.when(k % 3 == 0, "\n=== See also ===\nlist\n== More ==\nx").otherwise("\n== Empty ==\n\n== Last ==\nEnd.")
    return table(spark, d, "documents").select("doc_id", F.concat(headed, tail).alias("text"))


@query(
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[\\d+\\]', '', 'g'),"
    f" '(?ims)^={{2,}}\\s*(?:{T.TAIL_HEADINGS})\\s*={{2,}}\\s*?$.*\\z', ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g')) AS cleaned"
        f" FROM {_ART_SQL}"
)
def clean_text(spark, d):
    """X-02: article cleaning."""
    return _articles(spark, d).select("doc_id", F.md5(T.clean_article(F.col("text"))).alias("cleaned"))


@query(
    "WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^={2,}[ \\t]*(.+?)[ \\t]*={2,}[ \\t]*$', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p"
        " FROM " + _ART_SQL + "),"
    " e AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS i FROM m),"
    " s AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '' ELSE trim(string_split(part, chr(2))[1]) END AS header, regexp_replace(CASE WHEN i = 0 THEN part"
        " ELSE string_split(part, chr(2))[2] END, '^\\s+|\\s+\\z', '', 'g') AS body FROM e)"
    " SELECT doc_id, header, md5(body) AS body FROM s WHERE body <> ''"
)
def section_split(spark, d):
    """X-04: sections by heading lines."""
    return _articles(spark, d).select("doc_id", F.explode(T.sections(F.col("text"))).alias("s")).select("doc_id", "s.header", F.md5("s.body").alias("body"))


@query(
    "WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS p, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w"
        " FROM documents)"
    " SELECT doc_id, len(p) AS sentences, w AS words FROM s"
)
def sentence_words(spark, d):
    """X-05, X-06: sentences and words of each document."""
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"),
        T.word_count(F.col("text")).cast("bigint").alias("words"))


@query("SELECT event_id, CASE WHEN event_id % 9 < 7 THEN CAST(ts AS DATE) END AS day FROM events")
def question_date(spark, d):
    """D-01: dates that questions state, in each form; what is no date is passed over."""
    k, ts = F.col("event_id"), F.col("ts")
    day = lambda p: F.date_format(ts, p)
    forms = [
        F.concat(F.lit("News of "), day("yyyy-MM-dd"), F.lit(" today")), F.concat(F.lit("on "), day("yyyy.MM.dd")),
            F.concat(F.lit("on "), day("yyyy/M/d"), F.lit(".")), F.concat(F.lit("spoken "), day("yyyy.MMdd"), F.lit(" here")),
        F.concat(F.lit("On "), day("d MMMM yyyy"), F.lit(", x")), F.concat(day("MMM d"), F.lit("th, "), day("yyyy")),
            F.concat(F.lit("2026-13-45 then "), day("dd"), F.lit("st "), day("MMM"), F.lit(". "), day("yyyy")),
        F.concat(F.lit("31 Foo "), day("yyyy")), F.concat(F.lit("Feb 30, "), day("yyyy")),
    ]
    said = F.lit("none")
    for i, form in enumerate(forms):
        said = F.when(k % 9 == i, form).otherwise(said)
    return table(spark, d, "events").select("event_id", T.question_date(said).alias("day"))


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Waterfront ' || doc_id || '|Roman Empire' || doc_id || '|Carl X' || upper(lang)"
        " WHEN 1 THEN 'group life ' || lang || '|bystander effect' WHEN 2 THEN 'Pink Floyd|Moon The Beatles' ELSE '' END AS phrases FROM documents"
)
def phrase_extract(spark, d):
    """X-13: candidate titles of questions: quoted, capitalised, and concepts."""
    k, lang = F.col("doc_id").cast("string"), F.col("lang")
    q = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('Who wrote "Waterfront '), k, F.lit('" about Roman Empire'), k,
        F.lit("?"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("What describes the bystander effect in 'group life "), lang, F.lit("'?")))
    q = q.when(F.col("doc_id") % 4 == 2, "which of Washington It did Pink Floyd of the Moon")
    o = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("Carl X"), F.upper(lang)), F.lit("x"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("The Beatles")))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.candidate_phrases(q, o), "|").alias("phrases"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'budget ' || event_type || ' in Parliament' WHEN 1 THEN 'the ' || event_type || ' day'"
    " ELSE 'plain ' || event_type END AS q FROM events")
def news_query(spark, d):
    """D-02: questions without dates and lead-ins."""
    k, kind, ts = F.col("event_id"), F.col("event_type"), F.col("ts")
    q = F.when(k % 3 == 0, F.concat(F.lit("According to the article published on "), F.date_format(ts, "yyyy-MM-dd"), F.lit(", budget "), kind, F.lit(" in Parliament")))
    q = q.when(k % 3 == 1, F.concat(F.date_format(ts, "d MMMM yyyy"), F.lit(" the "), kind, F.lit(" day"))).otherwise(F.concat(F.lit(" plain "), kind, F.lit(" ")))
    return table(spark, d, "events").select("event_id", T.news_query(q).alias("q"))


@query("SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def corpus_dedup_keep_first(spark, d):
    """W-01: the first document of each text."""
    return C.keep_first(table(spark, d, "documents").withColumn("_h", F.sha2("text", 256)), ["_h"], ["doc_id"]).select("doc_id", "source", "lang", "n_chars")


@query(
    "WITH e AS (SELECT * FROM documents WHERE doc_id % 3 = 0), i AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE doc_id % 3 <> 0)"
    " SELECT doc_id, source FROM i WHERE r = 1 AND text NOT IN (SELECT text FROM e)"
)
def corpus_append(spark, d):
    """S-07, J-12: what an append adds, by text, to an existing third."""
    docs = table(spark, d, "documents").withColumn("_h", F.sha2("text", 256))
    return C.append_new(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), "_h", ["doc_id"]).select("doc_id", "source")


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(
    f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),"
    " c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((n - 300) / 250.0)) AS BIGINT) + 1)) AS chunk_id FROM n)"
    " SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, md5(array_to_string(w[chunk_id * 250 + 1 : chunk_id * 250 + 300], ' ')) AS digest FROM c"
)
def chunk_fixed(spark, d):
    """R-11, W-11: overlapping windows of 300 words."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(C.fixed_windows(T.words(F.col("text")), 300, 50)).alias("c"))
    return rows.select("doc_id", "c.chunk_id", F.md5("c.text").alias("digest"))


# A buffer is a range s..e of a text's words; what is flushed is one too.
_LAST = "CAST(greatest(0, ceil((n - 300) / 250.0)) AS BIGINT)"
_CHUNKS = (
    "WITH RECURSIVE p AS (SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')), lambda x: len(x) > 0) AS w"
        " FROM documents),"
    " z AS (SELECT doc_id, lang, flatten(w) AS words, list_transform(w, lambda x: len(x)) AS n FROM p),"
    " f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST([] AS BIGINT[][]) AS done FROM z UNION ALL"
    " SELECT doc_id, i + 1, CASE WHEN n > 300 THEN greatest(e + 1 + last * 250, e + n - 49) WHEN e - s + 1 + n > 300 THEN greatest(s, e - 49) ELSE s END, e + n,"
    " CASE WHEN n > 300 THEN list_concat(done, CASE WHEN e >= s THEN [[s, e]]"
        " ELSE [] END, [[e + 1 + k * 250, least(e + 300 + k * 250, e + n)] for k in range(0, last + 1)])"
        " WHEN e - s + 1 + n > 300 THEN list_append(done, [s, e]) ELSE done END"
    f" FROM (SELECT *, {_LAST} AS last FROM (SELECT f.*, z.n[i + 1] AS n FROM f JOIN z USING (doc_id) WHERE i < len(z.n)))),"
    " c AS (SELECT f.doc_id, CASE WHEN e >= s THEN list_append(done, [s, e]) ELSE done END AS done FROM f JOIN z ON z.doc_id = f.doc_id AND i = len(z.n)),"
    " u AS (SELECT doc_id, unnest(done) AS r, unnest(range(len(done))) AS k FROM c),"
    " g AS (SELECT *, sum(CASE WHEN k = 0 OR r[2] - r[1] + 1 >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM u),"
    " t AS (SELECT doc_id, grp, string_agg(array_to_string(words[r[1]:r[2]], ' '), ' ' ORDER BY k) AS text FROM g JOIN z USING (doc_id) GROUP BY doc_id, grp)"
)


@query(_CHUNKS + " SELECT CAST(t.doc_id AS VARCHAR) AS source, lang AS category, CAST(grp - 1 AS INTEGER) AS chunk_id"
    ", CAST(NULL AS VARCHAR) AS section_title, TRUE AS is_lead, md5(t.text) AS digest FROM t JOIN z USING (doc_id)")
def chunk_sentences(spark, d):
    """R-10: chunks bounded by sections and sentences."""
    articles = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text", F.col("lang").alias("category"))
    return C.chunk(articles).select("source", "category", "chunk_id", "section_title", "is_lead", F.md5("text").alias("digest"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),"
    " w AS (SELECT *, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) AS n FROM l WHERE trim(line) <> ''),"
    " s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w),"
    " g AS (SELECT *, sum(CASE WHEN n >= 20 OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM s)"
    " SELECT doc_id, CAST(grp - 1 AS INTEGER) AS chunk_id, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM g GROUP BY doc_id, grp"
)
def tail_merge(spark, d):
    """W-12: lines of under 20 words join the one before."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.merge_short(lines, 20)).alias("chunk_id", "t")).select("doc_id", "chunk_id", F.md5("t").alias("digest"))


@query(
    "SELECT doc_id, md5(CASE WHEN doc_id % 9 = 0 THEN ''"
        " ELSE source || ': ' END || text) AS plain, md5(source || ' (also known as: ' || lang || '; x) — S: ' || text) AS rich, md5(CASE"
        " WHEN doc_id % 9 = 0 THEN '' ELSE source || ' — S: ' END || text) AS part FROM documents"
)
def embedding_projection(spark, d):
    """F-14, F-15: the text that is embedded, of whole texts; without a source just the text."""
    none, no_text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    source = F.when(F.col("doc_id") % 18 == 0, " ").when(F.col("doc_id") % 9 != 0, F.col("source"))
    made = {"plain": C.embedding_text(source, none, no_text, F.col("text")),
        "rich": C.embedding_text(F.col("source"), F.array("lang", F.lit("x")), F.lit("S"), F.col("text")),
        "part": C.embedding_text(source, none, F.lit("S"), F.col("text"))}
    return table(spark, d, "documents").select("doc_id", *[F.md5(text).alias(name) for name, text in made.items()])


@query(
    "WITH RECURSIVE e(parent, child) AS (SELECT CASE WHEN doc_id % 7 = 0 THEN lang ELSE 'n' || doc_id // 3 END, 'n' || doc_id FROM documents UNION"
        " SELECT 'n' || doc_id, source FROM documents WHERE doc_id % 5 = 0 UNION SELECT source, lang FROM documents),"
    " r(node, depth) AS (SELECT 'en', 0 UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node WHERE r.depth < 30)"
        " SELECT node, min(depth) AS depth FROM r GROUP BY node"
)
def category_closure(spark, d):
    """S-21: what a bounded walk of a graph of languages, sources and documents, with cycles, reaches."""
    docs, name = table(spark, d, "documents"), lambda k: F.concat(F.lit("n"), k.cast("string"))
    k = F.col("doc_id")
    edges = docs.select(F.when(k % 7 == 0, F.col("lang")).otherwise(name(F.floor(k / 3))).alias("parent"), name(k).alias("child"))
    edges = edges.union(docs.where(k % 5 == 0).select(name(k), "source")).union(docs.select("source", "lang")).distinct()
    return C.closure(edges, ["en"], 30)


@query("SELECT DISTINCT source || '/' || lang AS title, CASE WHEN lang = 'fr' THEN upper(source) || ' (page)' WHEN lang = 'de' THEN upper(source)"
    " WHEN lang = 'es' THEN source || '/moved' ELSE source || '/' || lang END AS resolved FROM documents")
def title_resolution(spark, d):
    """J-13: titles through a normalisation and a redirect, either alone, and neither."""
    titles = table(spark, d, "documents").select("source", "lang", F.concat_ws("/", "source", "lang").alias("title")).distinct()
    normal = titles.where("lang in ('fr', 'de')").select(F.col("title").alias("from"),
        F.when(F.col("lang") == "de", F.upper("source")).otherwise(F.concat(F.upper("source"), F.lit("/f"))).alias("to"))
    moved = titles.where("lang = 'es'").select(F.col("title").alias("from"), F.concat("source", F.lit("/moved")).alias("to"))
    moved = moved.union(titles.where("lang = 'fr'").select(F.concat(F.upper("source"), F.lit("/f")), F.concat(F.upper("source"), F.lit(" (page)"))))
    return C.resolve_titles(titles.select("title"), normal, moved)


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text"
    " WHEN regexp_extract(left(text, 201), '(?s)\\A(.{0,199}[.!?])(?:\\s|\\z)', 1) <> '' THEN regexp_extract(left(text, 201), '(?s)\\A(.{0,199}[.!?])(?:\\s|\\z)', 1)"
    " WHEN regexp_extract(left(text, 200), '(?s)\\A(.+) ', 1) <> '' THEN regexp_extract(left(text, 200), '(?s)\\A(.+) ', 1)"
    " ELSE left(text, 200) END AS snippet FROM documents")
def truncate_sentence(spark, d):
    """X-07: passages cut at a sentence's end."""
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("snippet"))


@query("SELECT d.source, count(*) AS n, round(avg(l.quality), 9) AS quality, round(avg(l.toxic), 9) AS toxic FROM documents d"
    " JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
def label_quality_by_source(spark, d):
    """A-04's shape: labels by source."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"),
        "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 9).alias("quality"),
        F.round(F.avg("toxic"), 9).alias("toxic"))


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(spark, d):
    """U-05."""
    return table(spark, d, "documents").select("source").distinct()

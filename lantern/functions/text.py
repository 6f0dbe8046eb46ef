"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stoplist (negations and comparatives are kept on purpose).
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by",
    "for", "from", "had", "has", "have", "in", "into", "is", "it", "its",
    "of", "on", "or", "that", "the", "their", "them", "there", "these",
    "they", "this", "those", "to", "was", "were", "will", "with",
)

# Headings from which on an article is cut.
TAIL_HEADINGS = "References?|See also|External links?|Notes?|Further reading|Bibliography|Sources?|Citations?|Footnotes?"

# What marks a line as reasoning rather than a title.
PREAMBLES = r"thinking|thought|reasoning|analysis|process|let me|let's|okay|so\b|first|i need|i should|i'll|i will|we need|the user|the question|to answer|step\s*\d*"

# Month names.
MONTHS = (
    ("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9),
        ("october", 10), ("november", 11), ("december", 12),
    ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("sept", 9), ("oct", 10), ("nov", 11), ("dec", 12),
)

# What an answer's letter stands in, the most telling first; and the letter alone, of which the last counts.
ANSWER_PATTERNS = (
    r"(?i)\\boxed\{\s*([A-D])\s*\}",
    r"(?i)answer\s*[:\-]?\s*\(?([A-D])\)?",
    r"(?i)\b(?:final|correct)\s+answer\s*(?:is)?\s*[:\-]?\s*\(?([A-D])\)?",
    r"(?i)\boption\s+\(?([A-D])\)?",
    r"(?m)^([A-D])\s*[.)]",
)
BARE_LETTER = r"\b([A-D])\b"

# Dates as numbers with separators, as YYYY.MMDD, as day month year and as month day year.
ISO_DATE = r"\b(\d{4})[-./](\d{1,2})[-./](\d{1,2})\b"
COMPACT_DATE = r"\b(\d{4})\.(\d{2})(\d{2})\b"
DAY_MONTH_YEAR = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?\s+(\d{4})\b"
MONTH_DAY_YEAR = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"

# A stock lead-in of news questions.
LEAD_IN = r"(?i)^(?:according to|as reported (?:in|on|by)|based on|per)\s+(?:the\s+)?(?:article|report|story|piece)?\s*(?:published|reported|released)?\s*(?:on|in|by)?\s*"

# For candidate phrases.
QUOTED = r"\"[^\"]{3,60}\"|(?<![A-Za-z])'[^']{3,60}'"
PROPER_NOUNS = r"\b[A-Z][a-zA-Z0-9.]*(?:\s+(?:of|the|and|in|de|von)\s+[A-Z][a-zA-Z0-9.]*|\s+(?:[A-Z][a-zA-Z0-9.]*|[IVX]+))+"
CONCEPTS = "effect|theory|hypothesis|fallacy|syndrome|principle|paradox|dilemma|bias|disorder|cycle|reaction|law|imperative|dissonance"
LEADING_FILLER = (
    "the", "a", "an", "of", "this", "that", "its", "his", "her", "their", "which", "describes", "best",
    "concept", "term", "fundamental", "does", "did", "do", "is", "are", "was", "were",
)
STOP_PHRASES = ("which", "what", "how", "the following", "best describes", "according to")
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "of", "in", "on", "to", "for", "with", "from", "by", "as", "at", "is",
    "are", "was", "were", "be", "his", "her", "its", "it", "he", "she", "they", "this", "that", "their", "de",
    "von", "but", "into", "over",
)


def tokens(text: Column, drop_stopwords: bool = True) -> Column:
    """Lower-cased words; an empty array for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS)) if drop_stopwords else found


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean_article(text: Column) -> Column:
    """Without [n] citations and without what follows the first tail heading; blanks collapsed."""
    out = F.regexp_replace(text, r"\[\d+\]", "")
    out = F.regexp_replace(out, rf"(?ims)^={{2,}}\s*(?:{TAIL_HEADINGS})\s*={{2,}}\s*?$.*\z", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+\z", "")


def clean_news(text: Column) -> Column:
    """Horizontal blanks to one, three and more line breaks to two, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def sections(text: Column) -> Column:
    """array<struct<header, body>> at '== header ==' lines; what precedes the first has header ''; empty bodies are left out."""
    marked = F.split(F.regexp_replace(text, r"(?m)^={2,}[ \t]*(.+?)[ \t]*={2,}[ \t]*$", "\u0001$1\u0002"), "\u0001")
    parts = F.transform(
        marked,
        lambda p, i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(F.trim(F.element_at(F.split(p, "\u0002"), 1))).alias("header"),
            F.regexp_replace(F.when(i == 0, p).otherwise(F.element_at(F.split(p, "\u0002", 2), 2)), r"^\s+|\s+\z", "").alias("body"),
        ),
    )
    return F.filter(parts, lambda p: p["body"] != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def truncate(text: Column, most: int) -> Column:
    """At most so many characters: to the last sentence's end in them, else to the last word's, else hard."""
    window = F.substring(text, 1, most)
    ahead = F.substring(text, 1, most + 1)
    sentence = F.regexp_extract(ahead, rf"(?s)\A(.{{0,{most - 1}}}[.!?])(?=\s|\z)", 1)
    word = F.regexp_extract(window, r"(?s)\A(.+) ", 1)
    return F.when(F.char_length(text) <= most, text).when(sentence != "", sentence).when(word != "", word).otherwise(window)


def parse_answer(text: Column) -> Column:
    """0 for A to 3 for D: by the first of five patterns that occurs, else the last bare letter; null if none."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ANSWER_PATTERNS]
    bare = F.try_element_at(F.regexp_extract_all(text, F.lit(BARE_LETTER), F.lit(1)), F.lit(-1))
    return (F.ascii(F.upper(F.coalesce(*found, bare))) - 65).cast("bigint")


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?(?:</think>|\z)", ""))


def _title_like(line: Column) -> Column:
    return (line != "") & ~line.endswith(":") & ~line.rlike(rf"(?i)^(?:{PREAMBLES})\b") & (word_count(line) <= 6)


def distill_title(raw: Column, fallback: Column) -> Column:
    """A title from a model's output: after 'Title:', else the first line like one, else the fallback."""
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r'^"+|"+$', ""), r"^\*+|\*+$", ""))
    lines = F.filter(F.transform(F.split(strip_thinking(raw), r"\r?\n"), bare), lambda s: s != "")
    named = F.transform(F.filter(lines, lambda s: F.lower(s).startswith("title:")), lambda s: F.trim(F.regexp_replace(F.trim(F.substring(s, 7, 10**6)), r'^"+|"+$', "")))
    pick = lambda a: F.get(F.filter(a, _title_like), F.lit(0))
    return F.coalesce(pick(named), pick(lines), fallback)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def question_date(text: Column) -> Column:
    """The first date a question states: by numbers with - . /, YYYY.MMDD, day month year, month day year; one that isn't valid is passed over."""
    def numbers(p: str) -> Column:
        g = [F.regexp_extract(text, p, i) for i in (1, 2, 3)]
        return F.when(g[0] != "", _ymd(*g))

    month = F.create_map(*[F.lit(x) for pair in MONTHS for x in pair])
    def named(p: str, y: int, m: int, d: int) -> Column:
        g = {i: F.regexp_extract(text, p, i) for i in (1, 2, 3)}
        return F.when(g[1] != "", _ymd(g[y], F.try_element_at(month, F.lower(g[m])).cast("string"), g[d]))

    return F.coalesce(
        numbers(ISO_DATE), numbers(COMPACT_DATE), named(DAY_MONTH_YEAR, 3, 2, 1), named(MONTH_DAY_YEAR, 3, 1, 2),
    )


def news_query(question: Column) -> Column:
    """A question without its dates and stock lead-in; the question itself if nothing is left."""
    q = F.trim(question)
    for p in (ISO_DATE, COMPACT_DATE, DAY_MONTH_YEAR, MONTH_DAY_YEAR):
        q = F.regexp_replace(q, p, " ")
    q = F.regexp_replace(q, LEAD_IN, "")
    q = F.regexp_replace(F.regexp_replace(F.trim(q), r"\s+", " "), r"^[ ,.]+|[ ,.]+$", "")
    return F.coalesce(F.nullif(q, F.lit("")), F.trim(question))


def slug(text: Column, most: int = 60) -> Column:
    """Lower case, runs of other characters than letters, digits, dot and hyphen to one underscore."""
    return F.substring(F.regexp_replace(F.lower(text), r"[^a-z0-9.\-]+", "_"), 1, most)


def model_slug(model_id: Column) -> Column:
    tail = F.regexp_extract(model_id, r"([^/]*)$", 1)
    return F.when(F.coalesce(model_id, F.lit("")) == "", F.lit("mock")).otherwise(F.replace(F.lower(tail), F.lit(" "), F.lit("-")))


def candidate_phrases(question: Column, options: Column) -> Column:
    """Quoted spans, runs of capitalised words and concepts by their suffix, in this order, without fragments; the first of each spelling by lower case."""
    q = F.coalesce(question, F.lit(""))
    every = F.concat_ws(" ", q, F.array_join(F.filter(F.coalesce(options, F.array().cast("array<string>")), lambda o: o != ""), " "))
    tidy = lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[.,;:!?]+|[.,;:!?]+$", ""))
    quoted = F.transform(F.regexp_extract_all(q, F.lit(QUOTED), F.lit(0)), lambda s: F.substring(s, F.lit(2), F.char_length(s) - 2))
    proper = F.regexp_extract_all(every, F.lit(PROPER_NOUNS), F.lit(0))
    concept = F.regexp_extract_all(F.lower(q), F.lit(rf"\b((?:[a-z][a-z'-]+\s+){{1,2}}(?:{CONCEPTS}))\b"), F.lit(1))
    concept = F.transform(concept, lambda s: F.regexp_replace(s, rf"^(?:(?:{'|'.join(LEADING_FILLER)})\s+)+(?=\S)", ""))
    first, last = (lambda p: F.lower(F.element_at(F.split(p, r"\s+"), 1))), (lambda p: F.lower(F.element_at(F.split(p, r"\s+"), -1)))
    leads = [w for w in FUNCTION_WORDS if w not in ("the", "a", "an")]
    whole = lambda p: ~first(p).isin(*leads) & ~last(p).isin(*FUNCTION_WORDS) & ~(~p.contains(" ") & p.rlike("^[a-z]"))
    fit = lambda p: (F.char_length(p) >= 3) & ~F.lower(p).isin(*STOP_PHRASES)
    found = F.concat(F.transform(quoted, tidy), F.filter(F.transform(F.concat(proper, concept), tidy), whole))
    found = F.filter(found, fit)
    lowered = F.transform(found, F.lower)
    return F.filter(found, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1)

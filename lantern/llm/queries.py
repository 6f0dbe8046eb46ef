"""One query opN_<name> for each operator, on its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, lines, quality, resampling, suffixes, syncmers, transport, warc_zip, wrappers
from .common import table
from .mixing import mix
from .simhash import near_duplicates


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site shares, posterior and decision of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles over whole texts, linked at 2 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that repeats an earlier one, with at most one word edited, and the earliest it repeats."""
    return lines.duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
w AS (SELECT DISTINCT doc_id * 1000000 + pos AS place, list_filter(string_split_regex(line, '[\\x00-\\x20]+'), lambda x: x <> '') AS words FROM l),
t AS (SELECT place, words, array_to_string(words, ' ') AS own FROM w WHERE len(words) > 0),
d AS (SELECT own, any_value(words) AS words, min(place) AS place FROM t GROUP BY own),
g AS (SELECT own, words, place, unnest(range(len(words))) AS gap FROM d WHERE len(words) >= 5),
v AS (SELECT own, place, gap, len(words) AS n, array_to_string(list_concat(words[1:gap], words[gap + 2:]), ' ') AS variant FROM g),
pairs AS (
  SELECT own, min(best) AS best FROM (
    SELECT own, min(place) OVER (PARTITION BY n, gap, variant) AS best FROM v
    UNION ALL SELECT v.own, d.place FROM v JOIN d ON d.own = v.variant AND len(d.words) >= 5
    UNION ALL SELECT d.own, v.place FROM v JOIN d ON d.own = v.variant AND len(d.words) >= 5)
  GROUP BY own),
k AS (SELECT d.own, d.place AS first, least(d.place, coalesce(p.best, d.place)) AS kept FROM d LEFT JOIN pairs p ON p.own = d.own)
SELECT t.place // 1000000 AS doc_id, t.place % 1000000 AS line_no, k.kept // 1000000 AS kept_doc_id, k.kept % 1000000 AS kept_line_no,
       CAST(CASE WHEN k.kept = k.first THEN 0 ELSE 1 END AS INTEGER) AS edits
FROM t JOIN k ON k.own = t.own WHERE k.kept < t.place
"""


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return syncmers.with_edits(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated so that sources weigh as the square root of their size, in global random order."""
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


OP5_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c),
p AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, range(0, 200) AS g(k)),
d AS (SELECT d.*, CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, p.rate, count(*) FILTER (WHERE p.cdf <= d.u) AS copies
      FROM d JOIN p ON p.source = d.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, CAST(copy_no AS INTEGER) AS copy_no,
       CAST('0x' || substr(md5('mix/order:' || doc_id || ':' || copy_no), 1, 13) AS BIGINT) / 4503599627370496.0 AS shuffle_key
FROM m, LATERAL (SELECT unnest(range(0, copies)) AS copy_no)
"""


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, read by its host's wrapper."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by ranges; the digest columns of each record."""
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM h
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that also start elsewhere."""
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), texts=False)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, repaired at least cost and rendered."""
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, verbatim, in other letter case or with other numbers, names and units."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight toward the benchmark's texts, its score, and its rank if it is drawn."""
    found = resampling.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 has no function in SQL: each word's bytes go through the table of 256 steps, made by its rule.
OP11_SQL = """
WITH RECURSIVE step0 AS (SELECT i AS byte_no, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS g(i)
  UNION ALL SELECT byte_no, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step0 WHERE k < 8),
steps AS (SELECT byte_no, c FROM step0 WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (SELECT word, x, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM v
  UNION ALL SELECT word, x, k + 1, xor(crc.c >> 8, steps.c) FROM crc JOIN steps ON steps.byte_no = xor(crc.c & 255, CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) WHERE 2 * k < length(x)),
f AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * k = length(x)),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM dw JOIN f USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM bw JOIN f USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM dw) + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN f USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM o
"""


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a transport stream in a stored column, and what the demultiplexer reads from it."""
    streams = transport.stored(table(spark, sf_dir, "documents"), transport.folder(spark))
    return transport.features(streams).withColumnRenamed("id", "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each source, at each step of each of their 120 orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
f AS (SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM x a, x b, x c, x e, x g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order FROM o, x),
p AS (SELECT part, filter_order, step, f, fails[f] AS own, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone,
        len(list_filter(fails, lambda b: b)) AS failed, n, good, toxic FROM s, m),
a AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT own AND NOT gone) AS kept, sum(n) FILTER (WHERE own AND NOT gone) AS removed,
        sum(n) FILTER (WHERE own AND gone) AS redundant, sum(n) FILTER (WHERE own AND failed = 1) AS unique_fails,
        sum(good) FILTER (WHERE own AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE own AND NOT gone) AS toxic_lost FROM p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op5_mix_sources": OP5_SQL, "op7_warc_zip": OP7_SQL, "op11_importance_resampling": OP11_SQL,
        "op13_filter_audit": OP13_SQL}

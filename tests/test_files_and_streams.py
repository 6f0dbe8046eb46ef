"""Readers, writers and streams over small folders."""

import json

import pytest
from pyspark.sql import functions as F

from lantern import schemas
from lantern.sources import files as S
from lantern.sources import lexical
from lantern.streaming import logs as L


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "x", "text": "y"}\n\n{"title": "z"}\n')
    assert S.read_jsonl(spark, str(tmp_path / "a.jsonl"), schemas.ARTICLE).count() == 2
    (tmp_path / "b.jsonl").write_text('{"title": "x"}\nnot json\n')
    assert len(S.read_jsonl(spark, str(tmp_path / "b.jsonl"), schemas.ARTICLE, strict=False).collect()) == 1
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "b.jsonl"), schemas.ARTICLE).collect()


def test_run_logs(spark, tmp_path):
    (tmp_path / "run_1.jsonl").write_text("\n".join(json.dumps(x) for x in [{"run_kind": "manifest", "extra": {"strategy": "rag[Org/Qwen-7B|zero]"}}, {"run_kind": "question", "question_text": "q", "correct": None, "extras": {"top_score": 0.5, "new": 1}}]))
    (tmp_path / "run_2.jsonl").write_text(json.dumps({"run_kind": "question", "question_text": "r", "correct": True}))
    rows = S.read_run_logs(spark, str(tmp_path))
    q = {r.question_text: r for r in rows.where("run_kind = 'question'").collect()}
    assert q["q"].known.top_score == 0.5 and "new" in q["q"].extras and q["q"].correct is None and q["r"].known is None
    models = S.model_of(spark, str(tmp_path))
    assert [r.file_name for r in S.only_models(rows, models, include=["qwen"]).select("file_name").distinct().collect()] == ["run_1.jsonl"]
    assert [r.file_name for r in S.only_models(rows, models, exclude=["qwen"]).select("file_name").distinct().collect()] == ["run_2.jsonl"]
    assert S.latest_log(rows, "run").first()[0] == "run_2.jsonl"


def test_corpus_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([("a", "t", "science", "", [], ""), ("b", "t", "maths", "u", ["x"], "c")], schemas.ARTICLE)
    S.write_corpus(df, path)
    assert sorted(map(tuple, S.read_corpus(spark, path).collect())) == sorted(map(tuple, df.collect()))
    more = spark.createDataFrame([("b", "2", "maths", "", [], ""), ("d", "1", "maths", "", [], ""), ("d", "0", "maths", "", [], "")], schemas.ARTICLE)
    assert S.append_corpus(more, path, ["text"]) == 1 and S.append_corpus(more, path, ["text"]) == 0
    assert {(r.title, r.text) for r in S.read_corpus(spark, path).collect()} == {("a", "t"), ("b", "t"), ("d", "0")}


def test_index_manifest(spark, tmp_path):
    S.write_index(spark.createDataFrame([("t", [1.0])], "text string, embedding array<float>"), {"embedder": "m", "dim": 1, "overlap": 50}, str(tmp_path / "i"))
    chunks, warnings = S.read_index(spark, str(tmp_path / "i"), {"embedder": "m", "dim": 1, "overlap": 40})
    assert chunks.count() == 1 and len(warnings) == 1
    with pytest.raises(ValueError):
        S.read_index(spark, str(tmp_path / "i"), {"dim": 2})


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"strategy_name": "s", "accuracy": 0.5, "n_total": 3}, indent=1))
    (tmp_path / "b.json").write_text('{"strategy_name": "t"}')
    (tmp_path / "c.json").write_text("broken")
    (tmp_path / "d.json").write_text(json.dumps({"strategy_name": "u", "accuracy": 0.75, "n_total": 3, "ece": 0.12345}))
    assert [(r.strategy, r.ece) for r in S.leaderboard(S.read_reports(spark, str(tmp_path))).collect()] == [("u", 0.1234), ("s", None)]


def test_streams(spark, tmp_path):
    schema = "kind string, session_id string, question_text string, title string, correct boolean, ts timestamp"
    rows = [("f", "s", "q1", "T1", None, "2024-01-01 00:00:00"), ("f", "s", "q2", "T2", None, "2024-01-01 00:00:00"), ("f", "t", "q1", "T1", None, "2024-01-01 00:01:00"), ("o", "s", "q1", None, True, "2024-01-01 00:05:00"), ("o", "s", "q2", None, None, "2024-01-01 00:05:00"), ("o", "t", "q1", None, True, "2024-01-01 00:06:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(["kind", "session_id", "question_text", "title", "correct", "ts"], r))) for r in rows))
    stream = L.read_logs(spark, str(tmp_path / "in"), schema)
    learned = L.confirmed(stream.where("kind = 'f'"), stream.where("kind = 'o'"))
    q = L.grow(learned, str(tmp_path / "index"), str(tmp_path / "ck"), lambda b: b.select(F.col("title").alias("source"), F.lit("text").alias("text")))
    q.awaitTermination(120)
    assert [r.source for r in L.grown(spark, str(tmp_path / "index")).collect()] == ["T1"]
    again = L.grow(learned, str(tmp_path / "index"), str(tmp_path / "ck3"), lambda b: b.select(F.col("title").alias("source"), F.lit("text").alias("text")))
    again.awaitTermination(120)  # run again from the start: its batch replaces itself
    assert [r.source for r in L.grown(spark, str(tmp_path / "index")).collect()] == ["T1"]
    out = L.running_accuracy(L.read_logs(spark, str(tmp_path / "in"), schema).where("kind = 'o'")).writeStream.outputMode("complete").format("memory").queryName("acc").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {r.session_id: r.accuracy for r in spark.sql("select * from acc").collect()} == {"s": 0.5, "t": 1.0}
    log = L.append_log(L.read_logs(spark, str(tmp_path / "in"), schema), str(tmp_path / "log"), str(tmp_path / "ck2"))
    log.awaitTermination(120)
    assert spark.read.schema(schema).json(str(tmp_path / "log")).count() == 6
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    assert L.sessions(batch, "session_id").count() == 2


def test_bad_lines(spark, tmp_path):
    good = '{"run_kind": "question", "question_text": "q", "confidence": 0.5, "correct": true}'
    (tmp_path / "run_1.jsonl").write_text(f"{good}\n\n{good}\n{{broken\n")
    (tmp_path / "run_2.jsonl").write_text('{"question_text": "r", "confidence": 0.25, "correct": false}\n{"run_kind": "summary", "confidence": 1.0, "correct": true}\n')
    with pytest.raises(Exception, match="run_1.jsonl:4: invalid JSON"):
        S.read_run_logs(spark, str(tmp_path)).collect()
    rows = S.read_run_logs(spark, str(tmp_path), strict=False)
    assert [(r.file_name, r.line) for r in rows.orderBy("file_name", "line").collect()] == [("run_1.jsonl", 1), ("run_1.jsonl", 3), ("run_2.jsonl", 1), ("run_2.jsonl", 2)]
    assert S.questions(rows).count() == 2 and S.questions(rows, lacking=True).count() == 3 and S.calibration_rows(rows).count() == 3


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "long.txt").write_text("\n".join(f"{i:05d}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = S.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and all(int(r.value) == r.line - 1 for r in got)


def test_sets_reports_labels_and_cache(spark, tmp_path):
    gold = spark.createDataFrame([("q", ["a", "b"], 1, 3, 2, None, "run")], schemas.GOLD)
    S.write_set(gold, str(tmp_path / "gold"))
    assert S.read_set(spark, str(tmp_path / "gold")).collect() == gold.collect()
    S.write_report(spark.createDataFrame([("s", 0.5, 0.1, 1.0, 2.0, 3, "x")], schemas.REPORT + ", samples string"), str(tmp_path / "reports" / "s"))
    assert [r.n for r in S.leaderboard(S.read_reports(spark, str(tmp_path / "reports"))).collect()] == [3]
    rows = spark.createDataFrame([("q", "old"), ("r", None), ("s", "own")], "question_text string, gold_article_title string")
    labels = spark.createDataFrame([("q", "Z", 1), ("q", "A", 2), ("r", "R", 1), ("s", "S", 1), ("s", "", 2)], "question_text string, gold_article_title string, line int")
    assert {r.question_text: r.gold_article_title for r in S.overlay_labels(rows, labels).collect()} == {"q": "A", "r": "R", "s": "own"}
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    for key, response, at in (("full", '{"results": [{"id": 1}]}', "2023-01-01 00:00:00"), ("empty", '{"results": []}', "2024-01-01 00:00:00"), ("fresh", '{"results": []}', "2024-01-01 00:50:00"), ("legacy", "{}", None), ("full", '{"results": [{"id": 2}]}', "2023-06-01 00:00:00")):
        S.cache_put(spark.createDataFrame([(key, response, at)], "key string, response string, cached_at string").withColumn("cached_at", F.col("cached_at").cast("timestamp")), str(tmp_path / "cache"))
    wanted = spark.createDataFrame([("full",), ("empty",), ("fresh",), ("legacy",), ("none",)], "key string")
    got = {r.key: r.response for r in S.cache_get(spark, str(tmp_path / "cache"), wanted, now).collect()}
    assert got == {"full": '{"results": [{"id": 2}]}', "fresh": '{"results": []}', "legacy": "{}"}
    assert "full" not in {r.key for r in S.cache_get(spark, str(tmp_path / "cache"), wanted, now, ttl_seconds=60).collect()}


def test_extended_index(spark, tmp_path):
    rows = spark.createDataFrame([("A", "One two. Three four.", "science", "", ["Al"], 1), ("B", "Five six.", "maths", "", [], 2), ("A", "Other.", "science", "", [], 3)], "title string, text string, category string, url string, aliases array<string>, place int")
    encode = lambda text: F.array(F.char_length(text).cast("float"))
    path, manifest = str(tmp_path / "i"), {"embedder": "m", "dim": 1}
    assert S.extend_index(rows, path, encode, manifest, ["place"]) == 2 and S.extend_index(rows, path, encode, manifest, ["place"]) == 0
    got = {r.source: r.embedding for r in S.read_index(spark, path, manifest)[0].collect()}
    assert got == {"A": [len("A (also known as: Al): One two. Three four.")], "B": [len("B: Five six.")]}
    with pytest.raises(ValueError):
        S.extend_index(rows, path, encode, {"embedder": "other", "dim": 1}, ["place"])


def test_lexical_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox jumps", "red barn", "blue fox and red hen", "green field", "red red rose"])], "doc int, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "nothing known")], "query int, text string")
    whole = lexical.save(docs, "doc", "text", str(tmp_path / "a")).search(queries).collect()
    lexical.append(lexical.save(docs.where("doc < 3"), "doc", "text", str(tmp_path / "b")), docs.where("doc >= 3"), "doc", "text")
    grown = lexical.load(spark, str(tmp_path / "b"))
    assert grown.n_docs == 5 and sorted(grown.search(queries).collect()) == sorted(whole) and [r.doc for r in sorted(whole, key=lambda r: r.rank)][:1] == [0]
    (tmp_path / "b" / "header" / "new.json").write_text('{"generation": 9, "version": 1, "n_docs": 5, "n_tokens": 9}')
    with pytest.raises(ValueError, match="version 1"):
        lexical.load(spark, str(tmp_path / "b"))

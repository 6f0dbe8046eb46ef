"""Prompts, news items and small record functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_news


# What stands before context in a prompt, and the order of flags in a report's id.
REFERENCE_LEAD = "Reference material (may or may not be relevant):\n"
FLAGS = ("rag", "rerank", "hybrid", "mq", "math", "agent", "livesearch")


def options_block(options: Column) -> Column:
    return F.array_join(F.zip_with(F.array(*[F.lit(x) for x in "ABCD"]), options, lambda letter, text: F.concat_ws(". ", letter, text)), "\n")


def user_turn(question: Column, options: Column, instruction: str, context: Column | None = None) -> Column:
    """What is asked; the context, if there is one, stands between the options and the instruction."""
    extra = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(REFERENCE_LEAD), context, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("Question: "), question, F.lit("\n\nOptions:\n"), options_block(options), F.lit("\n\n"), extra, F.lit(instruction))


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(question: Column, options: Column, system: Column, instruction: str, context: Column | None = None, examples: Column | None = None) -> Column:
    """array<struct<role, content>>: system and user, and between them a user and an assistant turn for each example: array<struct<question, options, answer>>, null for none.

    A prompt with context has no examples.
    """
    asked = F.array(_turn("user", user_turn(question, options, instruction, context)))
    if examples is None:
        return F.concat(F.array(_turn("system", system)), asked)
    shown = F.flatten(F.transform(examples, lambda e: F.array(_turn("user", user_turn(e["question"], e["options"], instruction)), _turn("assistant", e["answer"]))))
    alone = F.lit(True) if context is None else F.coalesce(context, F.lit("")) == ""
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(_turn("system", system)), F.when(alone, F.coalesce(shown, none)).otherwise(none), asked)


def example_answer(letter: Column, rationale: Column, reasoned: bool) -> Column:
    """What an example's assistant says, in the form that the prompt asks for: the boxed letter after the rationale, if there is one and
    prompts ask for reasons, else the bare answer.
    """
    bare = F.concat(F.lit("Answer: "), letter)
    return F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(rationale, F.lit("\n\\boxed{"), letter, F.lit("}"))).otherwise(bare) if reasoned else bare


def mock_letter(prompt: Column) -> Column:
    """The deterministic stand-in for a model: the letter a prompt marks as gold, else A."""
    return F.coalesce(F.nullif(F.regexp_extract(prompt, r"<gold>([A-D])</gold>", 1), F.lit("")), F.lit("A"))


def news_article(item: Column) -> Column:
    """struct<title, text, category, url> of a news item, or null without title or body."""
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    body = F.coalesce(empty(item["fields"]["bodyText"]), empty(item["fields"]["trailText"]))
    title = F.coalesce(empty(item["webTitle"]), empty(item["fields"]["headline"]))
    day = F.substring(F.coalesce(item["webPublicationDate"], F.lit("")), 1, 10)
    text = clean_news(F.concat(F.when(day != "", F.concat(F.lit("Published "), day, F.lit(". "))).otherwise(""), body))
    return F.when(title.isNotNull() & body.isNotNull(), F.struct(title.alias("title"), text.alias("text"), F.lit("news").alias("category"),
        F.coalesce(item["webUrl"], F.lit("")).alias("url")))


def seconds_left(deadline: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(deadline) - F.unix_micros(now)) / 1e6)


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def days(first: Column, last: Column) -> Column:
    """A row per day is F.explode of this."""
    return F.sequence(first, last, F.expr("interval 1 day"))


def report_id(strategy: Column, model: Column, style: Column, flags: Column, at: Column) -> Column:
    """strategy__model__style__flags__stamp, with 'base' for no flags; flags in a fixed order."""
    order = F.array(*[F.lit(x) for x in FLAGS])
    on = F.filter(order, lambda f: F.array_contains(flags, f))
    return F.concat_ws("__", F.element_at(F.split(strategy, r"\["), 1), model, style, F.when(F.size(on) > 0, F.array_join(on, "-")).otherwise("base"), utc_stamp(at))


def contains_any(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k))


def passage_trace(passages: Column) -> Column:
    """array<struct<source, chunk_id, score, text_preview>> for a log: scores to four places, the first 200 characters of the text."""
    return F.transform(passages, lambda p: F.struct(p["source"].alias("source"), p["chunk_id"].alias("chunk_id"),
        F.bround(p["score"], 4).alias("score"), F.substring(p["text"], 1, 200).alias("text_preview")))


def nested(raw: Column, path: str, default: str | None = None) -> Column:
    """What stands at a path ('$.passages[0].source') of JSON text, else the default."""
    return F.coalesce(F.get_json_object(raw, path), F.lit(default))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key the right one's value stands."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(kept, right))

"""Small rules on records: texts of prompts and answers, envelopes, configuration, addresses, registries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


def question_text(prompt: Column, explicit: Column | None = None) -> Column:
    """An explicit question, else the texts of the user messages joined by line feeds."""
    said = F.transform(F.filter(prompt, lambda m: m["role"] == "user"), lambda m: T.parts_text(m["content"]))
    joined = T.strip(F.array_join(F.filter(said, lambda x: x != ""), "\n"))
    return joined if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), joined)


def reference_text(answers: Column) -> Column:
    """Reference answers in one line."""
    return F.coalesce(F.array_join(answers, " | "), F.lit(""))


def answer_list(answer: Column) -> Column:
    """A single answer as a list; null stays null."""
    return F.when(answer.isNotNull(), F.array(answer))


def last_assistant_text(messages: Column) -> Column:
    """The texts of the last assistant message that has contents, put together; '' if there is none."""
    own = F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].isNotNull())
    return F.coalesce(F.when(F.size(own) > 0, T.parts_text(F.element_at(own, -1)["content"], "")), F.lit(""))


def message_list(text: Column) -> Column:
    """A plain text as a conversation of one assistant message."""
    return F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce(text, F.lit("")).alias("content")))


def response_text(body: Column) -> Column:
    """The text of a model's JSON response, in whichever of three shapes it comes; null for others."""
    at = lambda p: F.nullif(F.get_json_object(body, p), F.lit(""))
    return F.coalesce(at("$.output_text"), at("$.output[0].content[0].text"), at("$.choices[0].message.content"))


def first_set(*columns: Column) -> Column:
    """The first argument that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def has_scheme(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit(False))


def upload_ttl(seconds: Column) -> Column:
    return F.greatest(F.lit(60), F.least(seconds, F.lit(3600)))


def failure(code: Column, message: Column, retryable: Column) -> Column:
    """An error in the one form that all tools report."""
    return F.struct(code.alias("code"), message.alias("message"), F.coalesce(retryable, F.lit(False)).alias("retryable"))


def envelope(call_id: Column, name: Column, parts: Column, error: Column, images: Column) -> Column:
    """A tool's result: ok unless there is an error; images come as parts behind the text."""
    more = F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda u: F.struct(F.lit("image").alias("type"), u.alias("text")))
    return F.struct(call_id.alias("call_id"), name.alias("name"), error.isNull().alias("ok"), F.concat(parts, more).alias("content"), error.alias("error"))


def request_problem(parts: Column) -> Column:
    """What is wrong with the input of a run request (array of type, text, uri), null if nothing is."""
    return (
        F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "input must be a non-empty list")
        .when(F.exists(parts, lambda p: F.coalesce(~p["type"].isin("text", "image"), F.lit(True))), "input has an unknown part")
        .when(F.exists(parts, lambda p: (p["type"] == "text") & (F.coalesce(T.strip(p["text"]), F.lit("")) == "")), "a text part is empty")
        .when(F.exists(parts, lambda p: (p["type"] == "image") & ~F.coalesce(p["uri"].rlike(r"(?i)^(?:https?|file|data|artifact):"), F.lit(False))), "an image has no usable address")
    )


def mode_list(value: Column, allowed: list[str]) -> Column:
    """(modes, unknown) of a list by commas: trimmed, each once, in order."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    known = F.array(*[F.lit(a) for a in allowed])
    return F.struct(F.filter(parts, lambda x: F.array_contains(known, x)).alias("modes"), F.array_except(parts, known).alias("unknown"))


def inherit(columns: dict[str, tuple[str, str]]) -> list[Column]:
    """Configuration columns with a parent's value where their own is not set: {name: (own, parent)}."""
    return [first_set(F.col(own), F.col(parent)).alias(name) for name, (own, parent) in columns.items()]


def same_order(a: Column, b: Column) -> Column:
    """Whether two lists hold the same in the same order."""
    return a.eqNullSafe(b)


def summary_or_text(summary: Column, content: Column, limit: int = 4000) -> Column:
    """A summary, or the beginning of the content where there is none."""
    return F.coalesce(F.nullif(T.strip(summary), F.lit("")), F.left(content, F.lit(limit)))


def scrub_json(text: Column, limit: int = 500, items: int = 20) -> Column:
    """A JSON text for the log: data URIs as marks of their length, texts cut at limit, lists at items, at any depth. What is no JSON is cut as a text. The depth has no bound, which no built-in function offers."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def clean(v):
            if isinstance(v, str):
                return f"<data-uri:{len(v)} chars>" if v.startswith("data:") else v[:limit]
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items()}
            return [clean(x) for x in v[:items]] if isinstance(v, list) else v

        def one(x):
            try:
                return json.dumps(clean(json.loads(x)), ensure_ascii=False)
            except (TypeError, ValueError, RecursionError):
                return None if x is None else x[:limit]

        for s in batches:
            yield s.map(one)

    return run(text)


def zip_positions(left: DataFrame, right: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """left and right joined by position; strict marks positions that one side lacks with an error instead of dropping them."""
    j = left.withColumn("_a", F.lit(1)).join(right.withColumn("_b", F.lit(1)), by, "full" if strict else "inner")
    return j.withColumn("error", F.when(F.col("_a").isNull() | F.col("_b").isNull(), "lengths differ")).drop("_a", "_b")


class Registry:
    """Named transforms of DataFrames: a name can be taken once; an unknown one is an error that tells what there is."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._by_name:
            raise ValueError(f"{name} is registered already")
        self._by_name[name] = f

    def names(self) -> list[str]:
        return list(self._by_name)

    def run(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._by_name:
            raise KeyError(f"unknown transform {name}; there are {', '.join(self._by_name)}")
        return self._by_name[name](df)

"""Rows of training sets: tool definitions, images, prompts for reinforcement learning, reports over datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import conversation as C
from . import images as I


def tools_error(names: Column, field: str = "tools") -> Column:
    """What is wrong with the tool definitions of a row, null if nothing is; names is the array of their functions' names: none at all, one without a name, one given twice (in this order of places). The wording is fixed."""
    at = lambda i, what: F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("] "), what)
    each = F.transform(
        names,
        lambda n, i: F.when(F.coalesce(n, F.lit("")) == "", at(i, F.lit("has no function name"))).when(F.array_contains(F.slice(names, F.lit(1), i), n), at(i, F.concat(F.lit("duplicates tool "), n))),
    )
    first = F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, f"{field} must be a non-empty list").otherwise(first)


def rl_error(prompt: Column, images: Column, answers: Column) -> Column:
    """What is wrong with a row for reinforcement learning, null if nothing is: its prompt, its images, its answers, image parts against images (in this order). The wording is fixed."""
    n, m = C.placeholders(prompt), F.coalesce(F.size(images), F.lit(0))
    empty = F.coalesce(F.size(answers), F.lit(0)) <= 0
    return (
        F.when(F.coalesce(F.size(prompt), F.lit(0)) <= 0, "prompt must be a non-empty message list")
        .when(I.list_error(images).isNotNull(), I.list_error(images))
        .when(empty | F.coalesce(F.exists(answers, lambda a: T.strip(a) == ""), F.lit(True)), "answer must contain at least one non-empty string")
        .when(n != m, F.concat(F.lit("image placeholder count "), n.cast("string"), F.lit(" does not match images count "), m.cast("string")))
    )


def answer_words(answers: Column) -> Column:
    """Words of the longest of several answers; 0 for none."""
    return F.coalesce(F.array_max(F.transform(answers, T.word_count)), F.lit(0)).cast("bigint")


def missing_images(rows: DataFrame, key: str, images: str, files: DataFrame, path: str) -> DataFrame:
    """(key, image) of each local image of a row (file://, or no scheme) that isn't among files(path); addresses of services aren't looked for."""
    u = rows.select(key, F.explode(images).alias("image")).where("image is not null")
    local = u.where(I.scheme(F.col("image")).isin("", "file")).withColumn("_p", F.regexp_replace("image", "^file://", ""))
    return local.join(files.select(F.col(path).alias("_p")), "_p", "left_anti").select(key, "image")

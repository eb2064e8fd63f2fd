"""Rewards of trajectories: format, accuracy and utility, with the fatal rule applied first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ACCURACY_WEIGHT, QUERY_WEIGHT = 0.8, 0.2


def exact_match(prediction: Column, references: Column) -> Column:
    """Whether a prediction equals one of an array of references, both normalised."""
    return F.exists(references, lambda r: T.normalise_answer(r) == T.normalise_answer(prediction))


def total(fmt: Column, accuracy: Column, utility: Column) -> Column:
    """format (0.8 accuracy + 0.2 utility); missing verdicts are 0."""
    return fmt * (F.coalesce(accuracy, F.lit(0.0)) * ACCURACY_WEIGHT + F.coalesce(utility, F.lit(0.0)) * QUERY_WEIGHT)


def _turns(messages: Column) -> Column:
    """The assistant turns of an array of messages: (turn, text, calls, is_error), is_error telling whether the message right behind is a failed tool result."""
    text = lambda m: T.parts_text(m["content"])
    every = F.transform(messages, lambda m, i: F.struct(i.alias("turn"), m["role"].alias("role"), text(m).alias("text"), m["tool_calls"].alias("calls"), (F.coalesce(F.get(messages, i + 1)["role"], F.lit("")) == "tool").alias("result"), i.alias("i")))
    mine = F.filter(every, lambda x: x["role"] == "assistant")
    failed = lambda x: x["result"] & T.is_error_observation(text(F.get(messages, x["i"] + 1)))
    return F.transform(mine, lambda x: F.struct(x["turn"].alias("turn"), x["text"].alias("text"), x["calls"].alias("calls"), failed(x).alias("is_error")))


def _answer(turns: Column) -> Column:
    """The response block of the last turn without calls that has one, '' for none."""
    blocks = F.transform(F.filter(turns, lambda x: F.coalesce(F.size(x["calls"]), F.lit(0)) <= 0), lambda x: T.response_block(x["text"]))
    return F.coalesce(F.try_element_at(F.filter(blocks, lambda b: b.isNotNull()), F.lit(-1)), F.lit(""))


def scores(rows: DataFrame, verdicts: DataFrame, key: str = "traj_id", least: int = 3) -> DataFrame:
    """(key, total, accuracy, utility, format, fatal) of each trajectory (key, messages, references), from judges' verdicts (key, accuracy, utility).

    A fatal trajectory has no prediction and so no accuracy, yet its cut prefix keeps its utility. An exact match needs
    no verdict; without a prediction accuracy is 0; without tool steps utility is 0. All is read off the array of
    messages, once: the only shuffle is that of the join with the verdicts.
    """
    t = rows.select(key, "references", _turns(F.coalesce("messages", F.filter("messages", lambda m: F.lit(False)))).alias("turns"))
    error = lambda i: F.coalesce(F.get("turns", i)["is_error"], F.lit(False))
    first = F.filter(F.transform("turns", lambda x, i: F.when(F.forall(F.sequence(i, i + least - 1), error), x["turn"])), lambda c: c.isNotNull())
    t = t.select(key, "references", "turns", F.get(first, F.lit(0)).alias("cut"))
    t = t.select(key, "references", (F.col("cut").isNotNull() | (_answer(F.col("turns")) == "")).alias("fatal"), F.filter("turns", lambda x: F.col("cut").isNull() | (x["turn"] < F.col("cut"))).alias("kept"))
    ok = F.transform("kept", lambda x: F.when(x["is_error"], 0.0).otherwise(T.well_formed_turn(x["text"], x["calls"]).cast("double")))
    fmt = F.when(F.size("kept") > 0, F.aggregate(ok, F.lit(0.0), lambda a, x: a + x) / F.size("kept")).otherwise(0.0)
    steps = F.exists("kept", lambda x: F.coalesce(F.size(x["calls"]), F.lit(0)) > 0)
    t = t.select(key, "references", "fatal", fmt.alias("format"), F.coalesce(steps, F.lit(False)).alias("acted"), F.when(F.col("fatal"), "").otherwise(_answer(F.col("kept"))).alias("prediction"))
    j = t.join(verdicts, key, "left")
    accuracy = F.when(F.col("prediction") == "", 0.0).when(F.coalesce(exact_match(F.col("prediction"), F.col("references")), F.lit(False)), 1.0).otherwise(F.coalesce("accuracy", F.lit(0.0)))
    utility = F.when(~F.col("acted"), 0.0).otherwise(T.clamp(F.coalesce("utility", F.lit(0.0)), 0.0, 1.0))
    j = j.select(key, "format", accuracy.alias("accuracy"), utility.alias("utility"), F.col("fatal").cast("double").alias("fatal"))
    return j.select(key, total(F.col("format"), F.col("accuracy"), F.col("utility")).alias("total"), "accuracy", "utility", "format", "fatal")


def batch_means(scored: DataFrame) -> DataFrame:
    """The mean of each of the five metrics."""
    return scored.agg(*[F.avg(c).alias(c) for c in ("total", "accuracy", "utility", "format", "fatal")])

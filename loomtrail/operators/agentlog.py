"""Logs of agents: events folded to messages and traces, counters, health of runs, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def trace(events: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, lines, trace): the lines of a run's events in order, null lines left out."""
    g = events.withColumn("_l", line).where("_l is not null").groupBy(key).agg(F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct(*order, "_l"))).alias("ls"))
    return g.select(key, "lines", F.array_join(F.transform("ls", lambda x: x["_l"]), "\n").alias("trace"))


def event_line(kind: Column, delta: Column, name: Column, arguments: Column, result: Column, limit: int = 3000) -> Column:
    """An agent event as a labelled line; other kinds give null."""
    return (
        F.when(kind == "message_delta", F.concat(F.lit("ASSISTANT: "), F.coalesce(delta, F.lit(""))))
        .when(kind == "tool_started", F.concat(F.lit("TOOL_CALL "), F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(arguments, F.lit("{}"))))
        .when(kind == "tool_finished", F.concat(F.lit("TOOL_RESULT "), F.coalesce(name, F.lit("")), F.lit(": "), F.left(F.coalesce(result, F.lit("")), F.lit(limit))))
    )


def fold_events(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, pos, role, text, name, call_id): messages of a run's events (type, delta, name, call_id, result). Deltas gather until a tool starts, which ends an assistant message even if it is empty; the rest is the last message unless blank."""
    w = Window.partitionBy(key).orderBy(order)
    start = F.col("type") == "tool_started"
    e = events.where("type in ('message_delta', 'tool_started', 'tool_finished')").withColumn("island", F.sum(F.when(start, 1).otherwise(0)).over(w) - F.when(start, 1).otherwise(0))
    said = e.where("type = 'message_delta' or type = 'tool_started'").groupBy(key, "island").agg(
        F.max(F.when(start, F.col(order))).alias("at"),
        F.max(order).alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == "message_delta", F.struct(order, F.coalesce("delta", F.lit("")).alias("d"))))), lambda x: x["d"]), "").alias("text"),
        F.max(F.when(start, F.col("name"))).alias("name"),
        F.max(F.when(start, F.col("call_id"))).alias("call_id"),
    )
    said = said.select(key, F.coalesce("at", "last").alias("pos"), F.lit("assistant").alias("role"), F.when(F.col("at").isNull(), T.strip(F.col("text"))).otherwise(F.col("text")).alias("text"), "name", "call_id", "at").where("at is not null or text <> ''").drop("at")
    done = e.where("type = 'tool_finished'").select(key, F.col(order).alias("pos"), F.lit("tool").alias("role"), F.coalesce("result", F.lit("")).alias("text"), "name", "call_id")
    return said.unionByName(done)


def counters(calls: DataFrame, episode: str, ok: str) -> DataFrame:
    """(episode, calls, failures)."""
    return calls.groupBy(episode).agg(F.count("*").alias("calls"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failures"))


def last_metrics(lines: DataFrame, marker: str = "'tools/call_frequency'") -> DataFrame:
    """One row of the last metric line of a log (line_no, line): call_rate, failure_rate, reward; the line is a dict literal in single quotes."""
    body = F.regexp_extract("line", r"(?s)\{.*\}", 0)
    last = lines.where(F.contains(F.col("line"), F.lit(marker)) & (body != "")).agg(F.max_by(body, "line_no").alias("b"))
    num = lambda k: F.regexp_extract("b", rf"'{k}'\s*:\s*'?(-?[0-9.]+(?:[eE][-+]?\d+)?)'?", 1).try_cast("double")
    return last.where("b is not null").select(num("tools/call_frequency").alias("call_rate"), num("tools/failure_frequency").alias("failure_rate"), num("reward").alias("reward"))


def run_health(metrics: DataFrame, most_failures: float = 0.0) -> DataFrame:
    """metrics with a column problem, null for a healthy run: tools were called, and failed no more than allowed."""
    return metrics.withColumn(
        "problem",
        F.when(F.coalesce("call_rate", F.lit(0.0)) <= 0, "no tool was executed").when(F.coalesce("failure_rate", F.lit(1.0)) > most_failures, "tools fail too often"),
    )


def batch_problem(world: Column, per_device: Column, accumulation: Column, global_batch: Column, group: Column | None = None) -> Column:
    """What is wrong with the sizes of a training profile, null if nothing is."""
    out = F.when(world * per_device * accumulation != global_batch, "global batch is not world size x per-device batch x accumulation")
    return out if group is None else out.when(global_batch % group != 0, "global batch is not divisible by the group size")


def contract_diff(called: DataFrame, name: str, contract: list[str]) -> DataFrame:
    """(name, calls, in_contract) of each tool called."""
    return called.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("calls")).withColumn("in_contract", F.col("name").isin(contract))


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]

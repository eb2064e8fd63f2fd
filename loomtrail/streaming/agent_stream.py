"""Structured Streaming over events of agents: windows with late data, state per run, appended traces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from ..functions import text as T


def windowed(events: DataFrame, at: str, late: str, size: str, slide: str | None = None, by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) over tumbling or sliding windows; rows later than `late` behind the watermark are dropped. The time column is made a zoned timestamp, as a watermark on a stream needs one."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    aggs = [F.count("*").alias("events")] + ([F.sum(value).alias("value")] if value else [])
    g = e.groupBy(w.alias("w"), *(by or [])).agg(*aggs)
    return g.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *(by or []), *[a for a in ["events"] + (["value"] if value else [])])


def session_windows(events: DataFrame, at: str, late: str, gap: str, by: str) -> DataFrame:
    """Sessions of each key that a gap ends."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = e.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("events"))
    return g.select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events")


def normalise_events(events: DataFrame) -> DataFrame:
    """(run_id, seq, type, tool, ok, error): raw events (run_id, seq, kind, tool, is_error, details) as tool_started, tool_finished or their own kind; a finished tool without structured details counts as failed."""
    kind = F.when(F.col("kind") == "tool_execution_start", "tool_started").when(F.col("kind") == "tool_execution_end", "tool_finished").otherwise(F.col("kind"))
    structured = F.coalesce(F.try_parse_json("details").isNotNull() & F.trim("details").startswith("{"), F.lit(False))
    done = F.col("kind") == "tool_execution_end"
    return events.select(
        "run_id",
        "seq",
        kind.alias("type"),
        "tool",
        F.when(done, structured & ~F.coalesce("is_error", F.lit(False))).alias("ok"),
        F.when(done & ~structured, "UNSTRUCTURED_RESULT").when(done & F.coalesce("is_error", F.lit(False)), F.coalesce(F.get_json_object("details", "$.error.code"), F.lit("TOOL_ERROR"))).alias("error"),
    )


RUN_STATE = "turns int, images array<string>, calls int, failures int"
RUN_OUT = "run_id string, turns int, images int, calls int, failures int, over_limit boolean"


def run_states(events: DataFrame, most_turns: int = 50) -> DataFrame:
    """State of each run over its events (run_id, type, uri, ok): turns against a cap, new images (an address counts once), calls and failures; a row for each run of each batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, images, calls, failures = state.get if state.exists else (0, [], 0, 0)
        images = list(images)
        for pdf in batches:
            turns += int((pdf["type"] == "turn_started").sum())
            done = pdf[pdf["type"] == "tool_finished"]
            calls += len(done)
            failures += int((~done["ok"].fillna(False).astype(bool)).sum())
            images += [u for u in dict.fromkeys(pdf["uri"].dropna()) if u not in images]
        state.update((turns, images, calls, failures))
        yield pd.DataFrame({"run_id": [key[0]], "turns": [turns], "images": [len(images)], "calls": [calls], "failures": [failures], "over_limit": [turns > most_turns]})

    return events.groupBy("run_id").applyInPandasWithState(update, RUN_OUT, RUN_STATE, "update", GroupStateTimeout.NoTimeout)


def append_traces(events: DataFrame, path: str, checkpoint: str, limit: int = 500):
    """Starts a query that appends trace lines as JSON, each text column scrubbed: data URIs as a mark of their length, anything else cut at limit."""
    texts = {f.name for f in events.schema if isinstance(f.dataType, StringType)}
    scrubbed = events.select(*[T.scrub(F.col(c), limit).alias(c) if c in texts else F.col(c) for c in events.columns])
    return scrubbed.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


CACHED = "namespace string, cache_key string, value string, updated_at double, hit boolean"


def cached_reads(reads: DataFrame, ttl: float = 7 * 24 * 3600, forget: bool = False) -> DataFrame:
    """(namespace, cache_key, value, updated_at, hit) of a stream of reads (namespace, cache_key, value, at) against a cache kept as keyed state: a read no later than ttl seconds behind the stored write is a hit and gets the stored value; any other stores its own, unless that is null. The reads of a key within a batch are taken in order of time. forget drops the state of keys that were silent for ttl; it is for streams that run on, as one that ends by itself would wait for the silence."""

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            hit = at is not None and r.at - at <= ttl
            if not hit and r.value is not None:
                value, at = r.value, float(r.at)
            out.append((*key, value if hit else r.value, at if hit else float(r.at), hit))
        if at is not None:
            state.update((value, at))
            if forget:
                state.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame(out, columns=["namespace", "cache_key", "value", "updated_at", "hit"])

    return reads.groupBy("namespace", "cache_key").applyInPandasWithState(serve, CACHED, "value string, at double", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)

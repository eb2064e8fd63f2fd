"""Joins in time and by range, and windows over events: beyond the usual equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def from_micros(m: Column) -> Column:
    """The time without a zone of micros()."""
    return F.timestamp_add("MICROSECOND", m, F.lit("1970-01-01").cast("timestamp_ntz"))


def asof(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row at or before each left row of the same key: one union, one sort; no join."""
    r = F.struct(right_at, *values)
    a = left.select(F.col(by).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType).alias("_v"))
    b = right.select(F.col(by).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_l"), r.alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_s = 1")
    return u.select("_l.*", *[F.col(f"_f.{v}").alias(v) for v in values])


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, bin_size: float) -> DataFrame:
    """points joined with the ranges low <= at < high: an equi join on bins, so that no nested loop is needed."""
    p = points.withColumn("_b", F.floor(F.col(at) / bin_size))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size))))
    return p.join(r, "_b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def sessions(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """(by, session, begin, end, events): runs of events with gaps of at most gap_seconds."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(micros(F.col(at)) - F.lag(micros(F.col(at))).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    s = events.withColumn("_n", new).withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "session").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count("*").alias("events"))

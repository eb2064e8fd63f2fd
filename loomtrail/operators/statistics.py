"""Aggregates and samples whose result doesn't depend on how rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(rows: DataFrame, by: str, value: str, p: float = 0.95) -> DataFrame:
    """(by, n, low, median, p95, high) of a whole-numbered column. p95 is the nearest rank sorted[min(n - 1, int(p n))], the median the mean of the middle two.

    Values are counted first, so that a window sees a group's distinct values and never its rows. Nulls don't count.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    c = c.withColumn("n", F.sum("c").over(w)).withColumn("cum", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("cum") > rank, F.col("v")))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return c.groupBy(by).agg(
        F.max("n").alias("n"),
        F.min("v").alias("low"),
        ((at(lo) + at(hi)) / 2.0).alias("median"),
        at(F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p).cast("decimal(10,6)")))).alias("p95"),
        F.max("v").alias("high"),
    )


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that other engines can reproduce: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_rows(rows: DataFrame, key: str, ratio: float, seed: int = 3407) -> DataFrame:
    """rows with a column split: validation for exactly int(n ratio) rows, the first in hashed order, train for the rest.

    The order is cut into 65,536 ranges by the first digits of the hash; counts tell the range in which the cut falls,
    and only that range is sorted.
    """
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be in [0, 1)")
    h = rows.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 4))
    counts = h.groupBy("_b").agg(F.count("*").alias("c"))  # at most 65,536 rows
    total = F.sum("c").over(Window.partitionBy())
    before = F.sum("c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    cut = F.floor(total * F.lit(ratio).cast("decimal(10,6)"))
    plan = counts.select("_b", (cut - before).alias("_take"), "c")
    j = h.join(F.broadcast(plan), "_b")
    inside = j.where("_take > 0 and _take < c").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    out = lambda d, s: d.select(*rows.columns, s.alias("split"))
    return (
        out(j.where("_take <= 0"), F.lit("train"))
        .unionByName(out(j.where("_take >= c"), F.lit("validation")))
        .unionByName(out(inside, F.when(F.col("_r") <= F.col("_take"), "validation").otherwise("train")))
    )


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first eight digits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bernoulli(rows: DataFrame, key: str, share: float, seed: str = "subset") -> DataFrame:
    """Rows chosen each with the probability share, the same in every run."""
    return rows.where(hash_unit(F.col(key), seed) < share)


def weighted_choice(unit: Column, weights: dict[int, float]) -> Column:
    """The value whose share of the total weight a number in [0, 1) falls into."""
    if not weights:
        raise ValueError("nothing to choose from")
    total, edge, out = sum(weights.values()), 0.0, None
    items = sorted(weights.items())
    for v, w in items[:-1]:
        edge += w / total
        out = F.when(unit < edge, v) if out is None else out.when(unit < edge, v)
    return F.lit(items[-1][0]) if out is None else out.otherwise(items[-1][0])


def hop_count(unit: Column, low: int = 2, high: int = 4) -> Column:
    """2, 3 or 4 hops by weights of 0.4, 0.4 and 0.2, within the limits."""
    weights = {k: w for k, w in ((2, 0.4), (3, 0.4), (4, 0.2)) if low <= k <= high}
    if not weights:
        raise ValueError("the limits must include 2, 3 or 4")
    return weighted_choice(unit, weights)


def ordered_distinct(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each value, in the given order; a row is chosen by its order columns alone, which must be unique within a value."""
    first = rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("_o"))
    o = [F.col(f"_o.{c}").alias(c) for c in order]
    keys = first.select(*by, *o)
    cond = None
    left, right = rows.alias("l"), keys.alias("r")
    for c in [*by, *order]:
        e = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        cond = e if cond is None else cond & e
    return left.join(right, cond, "left_semi")


def leave_one_out(rows: DataFrame, group: str, reward: str, fatal: str | None = None, tokens: str | None = None) -> DataFrame:
    """rows with mean and advantage: (reward - mean of its group) n / (n - 1) for groups of two or more, (reward - mean) else; not below 0 for fatal rows; times tokens, at least 1."""
    g = rows.groupBy(group).agg(F.avg(reward).alias("mean"), F.count(reward).alias("_n"))
    j = rows.join(g, group)
    a = (F.col(reward) - F.col("mean")) * F.when(F.col("_n") > 1, F.col("_n") / (F.col("_n") - 1)).otherwise(1.0)
    if fatal:
        a = F.when(F.coalesce(F.col(fatal), F.lit(False)), F.greatest(a, F.lit(0.0))).otherwise(a)
    if tokens:
        a = a * F.greatest(F.lit(1), F.coalesce(F.col(tokens), F.lit(0)))
    return j.withColumn("advantage", a).drop("_n")

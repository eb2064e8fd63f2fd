"""Similarity of stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BASE_BLOCK = 2000, 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length or a null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def top_k(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """(query_id, rank, key, score): the k nearest other rows of base by cosine, ties by key, for every query against all rows.

    Queries and base are cut into blocks by hash; each pair of blocks is one product of matrices in a task, which keeps
    k rows per query; a window over (blocks x k) rows per query makes the result. Neither side goes to all tasks.
    """
    nq, nb = queries.count(), base.count()
    qb, bb = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nb // BASE_BLOCK))
    bb = max(bb, min(32, max(1, nb // 500)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), block(key, qb).alias("q")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bb - 1))))
    b = base.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), block(key, bb).alias("b")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def unit(s: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(x, dtype=np.float64) for x in s])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)

    def product(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        s = unit(left["v"]) @ unit(right["v"]).T
        ids = right["id"].to_numpy()
        s = np.where(np.isnan(s) | (left["id"].to_numpy()[:, None] == ids[None, :]), -np.inf, s)
        m = min(k, len(ids))
        order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, :m]
        rows = np.repeat(np.arange(len(left)), m)
        out = pd.DataFrame({"query_id": left["id"].to_numpy()[rows], "id": ids[order.ravel()], "score": s[rows, order.ravel()]})
        return out[np.isfinite(out["score"])]

    got = q.groupBy("q", "b").cogroup(b.groupBy("q", "b")).applyInPandas(product, "query_id bigint, id bigint, score double")
    if least is not None:
        got = got.where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return got.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def best_candidate(pairs: DataFrame, sample: str, position: str, score: str, least: float = 0.28) -> DataFrame:
    """The row with the highest score of at least `least` of each sample; the first position wins a tie; rows without a score fall out."""
    ok = pairs.where(F.col(score) >= least)
    rest = [c for c in pairs.columns if c != sample]
    return ok.groupBy(sample).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position))).alias("_r")).select(sample, "_r.*")

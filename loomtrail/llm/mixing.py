"""Problem 7: sources mixed to target weights of tokens.

The amount of each source follows from its target share and its cap on repeats. Iterative proportional fitting rakes the
token weights of the cells (source, language, topic) to the sources' amounts and to the corpus's own shares of languages
and topics. Documents are then sampled by the calibrated weights of their cells: systematic sampling in blocks, so that
each document is used the floor or the ceiling of its weight.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from .encode import token_count

BLOCK_ROWS = 5000
MOST_SOURCES, MOST_LANGS, MOST_TOPICS = 1000, 32, 32


def topics(documents: DataFrame, most: int = MOST_TOPICS) -> list[str]:
    """The words that name most documents by their page's title, the commonest first: counted over all documents; words of one letter and figures are none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("page_title"), F.lit(r"(\p{L}{2,})"), 1))
    titles = documents.where("page_title is not null").groupBy("page_title").agg(F.count("*").alias("n"))
    return [r["w"] for r in titles.select("n", F.explode(words).alias("w")).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "w").limit(most).collect()]


def topic(title: Column, words: list[str]) -> Column:
    """The first of words that stands in a title; other for none of them, none for a null title."""
    mine = F.regexp_extract_all(F.lower(title), F.lit(r"(\p{L}{2,})"), 1)
    first = F.get(F.array_intersect(F.array(*[F.lit(w) for w in words]).cast("array<string>"), mine), F.lit(0))
    return F.when(title.isNull(), "none").otherwise(F.coalesce(first, F.lit("other")))


def language(lang: Column) -> Column:
    """The two letters of a language, und for anything else."""
    two = F.lower(F.regexp_extract(lang, r"^([A-Za-z]{2})(?:$|[-_])", 1))
    return F.coalesce(F.when(two != "", two), F.lit("und"))


def languages(documents: DataFrame, most: int = MOST_LANGS) -> list[str]:
    """The commonest languages; the others are one margin."""
    return [r["l"] for r in documents.groupBy(language(F.col("lang")).alias("l")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").limit(most).collect()]


def amounts(available: dict[str, float], targets: dict[str, float], caps: dict[str, float | None], total: float | str | None = None, fill: bool = False) -> dict[str, float]:
    """Tokens of each source: its target share of total, at most cap times what it has.

    total None means all available tokens; "exact" the largest total at which no source with documents falls short of
    its share, so that the mix has the target shares exactly, at the price of a size that the scarcest source dictates.
    fill shares what capped sources leave among the others, in proportion to their targets.
    """
    top = {s: (math.inf if caps.get(s) is None else caps[s] * available[s]) for s in available}
    open_ = {s for s in available if available[s] > 0 and targets.get(s, 0) > 0}
    out = dict.fromkeys(available, 0.0)
    if total == "exact":
        total = min((top[s] / targets[s] for s in open_), default=0.0)
        total = total if math.isfinite(total) else float(sum(available.values()))
    left = float(sum(available.values()) if total is None else total)
    if not fill:
        return out | {s: min(targets[s] * left, top[s]) for s in open_}
    while open_:
        scale = left / sum(targets[s] for s in open_)
        full = {s for s in open_ if targets[s] * scale >= top[s]}
        if not full:
            out.update({s: targets[s] * scale for s in open_})
            break
        for s in full:
            out[s] = top[s]
            left -= top[s]
        open_ -= full
    return out


def rake(cells: pd.DataFrame, amount: dict[str, float], caps: dict[str, float | None], rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """Weights of the cells (columns source, lang, topic, tokens): tokens of the mix by tokens of the corpus; and how many rounds it took. Sources are met last, so that theirs are exact; a weight stays within its source's cap. Margins that sources and caps rule out together are met as far as they allow."""
    have = cells["tokens"].to_numpy(dtype=float)
    w = np.ones(len(cells))
    cap = np.array([math.inf if caps.get(s) is None else float(caps[s]) for s in cells["source"]])
    total = sum(amount.values())
    margins = []
    for column in ("lang", "topic"):
        codes, names = pd.factorize(cells[column])
        share = np.bincount(codes, weights=have, minlength=len(names))
        margins.append((codes, share / max(share.sum(), 1e-12) * total))
    sources, names = pd.factorize(cells["source"])
    goal = np.array([amount.get(s, 0.0) for s in names])

    def to_sources(w: np.ndarray) -> np.ndarray:
        for _ in range(200):  # cells at their cap leave the rest to the others
            now = np.bincount(sources, weights=w * have, minlength=len(names))
            f = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[sources]
            new = np.minimum(w * f, cap)
            if np.allclose(new, w, rtol=1e-9, atol=0):
                break
            w = new
        return w

    done = 0
    for done in range(1, rounds + 1):
        old = w.copy()
        for codes, want in margins:
            now = np.bincount(codes, weights=w * have, minlength=len(want))
            w = np.minimum(w * np.clip(np.divide(want, now, out=np.ones_like(want), where=now > 0), 0.2, 5.0)[codes], cap)
        w = to_sources(np.maximum(w, 1e-9))
        if np.max(np.abs(w - old), initial=0.0) < tolerance:
            break
    return w, done


def _calibrated(documents: DataFrame, targets: DataFrame, total: float | str | None, fill: bool, path: str | None) -> tuple[DataFrame, pd.DataFrame, int]:
    """(documents with source, lang, topic and tokens; cells with their weights w; rounds)."""
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r["source"] for r in rows}) < len(rows):
        raise ValueError("targets must be at most 1,000 sources, each once")
    share = {r["source"]: float(r["target_share"] or 0.0) for r in rows}
    caps = {r["source"]: None if r["max_repeats"] is None else int(r["max_repeats"]) for r in rows}
    listed = F.broadcast(targets.where("source is not null").select("source"))  # at most 1,000 rows, as checked
    d = documents.where("source is not null and text is not null").join(listed, "source")
    known, said = languages(d), topics(d)
    lang = F.when(language(F.col("lang")).isin(known), language(F.col("lang"))).otherwise("other")
    d = spread(d.select("doc_id", "source", "lang", "page_title", "text")).select("doc_id", "source", lang.alias("lang"), topic(F.col("page_title"), said).alias("topic"), token_count(F.col("text"), path).alias("tokens"))
    d = materialize(d, "counted").where("tokens > 0")  # filtered behind the table: a filter before it would count twice
    # 1,000 sources x 33 languages x 34 topics at most: 1.1 million rows, 60 MB
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toPandas().sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    available = {s: float(v) for s, v in cells.groupby("source")["tokens"].sum().items()}
    amount = amounts({s: available.get(s, 0.0) for s in share}, share, caps, total, fill)
    cells["w"], rounds = rake(cells, amount, caps)
    return d, cells, rounds


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, fill: bool = False, path: str | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies) of each document that the mix uses.

    total is the size in tokens of which each source gets its share as far as its cap allows; by default all tokens of
    the listed sources' documents (see amounts). Documents without a source, of an unlisted source or without tokens
    take no part. A listed source without documents gets nothing. A null cap is none; a source listed twice is an error.
    targets must be small: it is collected, more than 1,000 rows are an error.
    """
    d, cells, _ = _calibrated(documents, targets, total, fill, path)
    cells["cell"] = np.arange(len(cells))
    cells["blocks"] = np.maximum(1, cells.groupby("source")["n"].transform("sum") // BLOCK_ROWS)
    spark = documents.sparkSession
    table = spark.createDataFrame(cells[["source", "lang", "topic", "w", "cell", "blocks"]], "source string, lang string, topic string, w double, cell bigint, blocks bigint")
    j = d.join(F.broadcast(table), ["source", "lang", "topic"]).withColumn("block", F.expr(f"pmod(xxhash64(doc_id, {seed}), blocks)"))
    # a line on which each document has the length of its weight, in the order of cells and sizes; whole numbers are uses
    line = Window.partitionBy("source", "block").orderBy("cell", "tokens", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "block", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    end = F.round(F.sum("w").over(line) + start, 9)
    copies = F.floor(end) - F.floor(F.round(F.sum("w").over(line) - F.col("w") + start, 9))
    return j.select("doc_id", "source", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def mix_report(documents: DataFrame, targets: DataFrame, total: float | str | None = None, fill: bool = False, path: str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, most_copies, actual_share) of each listed source; tokens counts repeats."""
    m = mix(documents, targets, total, fill, path).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    r = targets.where("source is not null").select("source", "target_share", "max_repeats").join(m, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_copies")])
    all_ = F.sum("tokens").over(Window.partitionBy())  # one row for each listed source
    return r.withColumn("actual_share", F.when(all_ > 0, F.col("tokens") / all_).otherwise(0.0))


def margin_report(documents: DataFrame, targets: DataFrame, total: float | str | None = None, fill: bool = False, path: str | None = None) -> DataFrame:
    """(margin, value, target_share, actual_share, residual, rounds) of the calibrated weights for each source, language and topic.

    The target of a source is its part of the mix as far as its cap allows, that of a language or topic its share of all
    tokens of the listed sources. residual is what is left between the two: sources come first, and caps bind, so that
    languages and topics are met only as far as the sources' own texts allow. rounds is how often all margins were raked.
    """
    _, cells, rounds = _calibrated(documents, targets, total, fill, path)
    out = []
    mixed = float((cells["w"] * cells["tokens"]).sum())
    have = float(cells["tokens"].sum())
    wanted = {r["source"]: float(r["target_share"] or 0.0) for r in targets.where("source is not null").limit(MOST_SOURCES).collect()}
    for margin in ("source", "lang", "topic"):
        for value, g in cells.groupby(margin):
            want = wanted[value] if margin == "source" else float(g["tokens"].sum()) / have
            got = float((g["w"] * g["tokens"]).sum()) / mixed if mixed else 0.0
            out.append((margin, value, want, got, got - want, rounds))
    return documents.sparkSession.createDataFrame(out, "margin string, value string, target_share double, actual_share double, residual double, rounds int")

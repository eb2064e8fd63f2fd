"""Link graphs: degrees, eligibility, paths and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .statistics import hop_count, hash_unit

HUB_CAP, LEAST_IN, MOST_LINKS, MOST_CANDIDATES = 10_000, 50, 500, 40


def edges(pages: DataFrame, limit: int = MOST_LINKS) -> DataFrame:
    """(src, dst, relation, pos): valid links of each page in order, each title once, at most limit."""
    e = pages.where("title is not null").select(F.col("title").alias("src"), F.posexplode("outgoing").alias("pos", "o")).select("src", F.col("o.title").alias("dst"), F.col("o.relation").alias("relation"), "pos")
    e = e.where(T.valid_title(F.col("dst")))
    first = e.groupBy("src", "dst").agg(F.min(F.struct("pos", "relation")).alias("m")).select("src", "dst", F.coalesce(F.nullif(F.left("m.relation", F.lit(160)), F.lit("")), F.lit("linked from the article")).alias("relation"), "m.pos")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("pos"))).where(F.col("_r") <= limit).drop("_r")


def in_degree(links: DataFrame) -> DataFrame:
    """(dst, degree)."""
    return links.groupBy("dst").agg(F.count("*").alias("degree"))


def seed_ok(incoming: Column, low: int = LEAST_IN, high: int = HUB_CAP) -> Column:
    return F.coalesce(incoming.between(low, high), F.lit(False))


def node_ok(incoming: Column, extract: Column, high: int = HUB_CAP, least_extract: int = 200) -> Column:
    """Whether a page may be visited: no hub, and enough text."""
    return F.coalesce((incoming <= high) & (F.length(T.squeeze(extract)) >= least_extract), F.lit(False))


def page_ok(extract: Column, incoming: Column, exists: Column, disambiguation: Column, image: Column | None = None, templates: Column | None = None, high: int = HUB_CAP, least_extract: int = 200) -> Column:
    """Whether a fetched page may be used: there, no disambiguation, enough text, no hub; and, where image and templates are given (a start must be pictured), with an image and an infobox among its templates."""
    ok = F.coalesce(exists, F.lit(False)) & ~F.coalesce(disambiguation, F.lit(False)) & node_ok(incoming, extract, high, least_extract)
    if image is not None:
        ok = ok & (F.coalesce(image, F.lit("")) != "")
    if templates is not None:
        ok = ok & F.coalesce(F.exists(templates, lambda t: F.contains(T.fold(t), F.lit("infobox"))), F.lit(False))
    return ok


def seed_batches(titles: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """titles with batch, from 0: seeds in hashed order, size to a batch; which rows share a batch depends on the seed and the titles alone. Batches are cut within hash ranges, so that no task orders all titles."""
    h = F.xxhash64(F.lit(seed), key)
    t = titles.withColumn("_h", h).withColumn("_part", F.shiftright("_h", 54))
    counts = t.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_off")  # at most 1,024 rows
    no = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)) - 1 + F.col("_off")
    return t.join(F.broadcast(before), "_part").withColumn("batch", F.floor(no / size).cast("bigint")).drop("_h", "_part", "_off")


def first_links(links: DataFrame, fan_out: int) -> DataFrame:
    """(src, dst, relation): the first fan_out links of each node by position."""
    return links.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("pos"))).where(F.col("_r") <= fan_out).select("src", "dst", "relation")


def _further(p: DataFrame, e: DataFrame) -> DataFrame:
    n = e.select(F.col("src").alias("end"), "dst", "relation")
    return p.join(n, "end").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array("relation")).alias("relations"), F.col("dst").alias("end"))


def path_levels(starts: DataFrame, links: DataFrame, low: int, high: int, fan_out: int = MOST_CANDIDATES) -> dict[int, DataFrame]:
    """Acyclic paths (path, relations, end) of low to high links from starts(title), by their number of links, following at most fan_out links of a node, the first by position.

    The cut is on the link table, once, before any join, so that no step can explode beyond fan_out per node. The links,
    and the paths of each number of links but the highest, are kept in the shared folder, and the next one goes on from there.
    """
    e = materialize(first_links(links, fan_out), "links")
    p = starts.select(F.array("title").alias("path"), F.array().cast("array<string>").alias("relations"), F.col("title").alias("end"))
    out = {}
    for hops in range(1, high + 1):
        p = _further(p, e)
        if low <= hops < high:
            p = materialize(p, f"paths-{hops}")
        if hops >= low:
            out[hops] = p
    return out


def paths(starts: DataFrame, links: DataFrame, hops: int, fan_out: int = MOST_CANDIDATES) -> DataFrame:
    """(path, relations): the acyclic paths of exactly hops links, see path_levels()."""
    return path_levels(starts, links, hops, hops, fan_out)[hops].select("path", "relations")


def walks(starts: DataFrame, links: DataFrame, seed: str, low: int = 2, high: int = 4) -> DataFrame:
    """(title, hops, path, complete): one acyclic walk from each start, with a weighted number of hops. A step takes the first link in hashed order that leads to no page of the walk; as a walk has at most high pages, trying the first high + 1 links would do, so a limit on tries never tells. A walk that ends early stays, with complete false."""
    p = starts.select("title", hop_count(hash_unit(F.col("title"), seed), low, high).alias("hops"), F.array("title").alias("path"), F.lit(False).alias("dead"))
    for k in range(1, high + 1):
        go = p.where((F.col("hops") >= k) & ~F.col("dead"))
        stay = p.where((F.col("hops") < k) | F.col("dead"))
        j = go.join(links.select(F.col("src").alias("_s"), "dst"), F.element_at("path", -1) == F.col("_s"), "left").where("dst is null or not array_contains(path, dst)")
        h = F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(k)), F.col("title"), F.col("dst")))
        best = j.groupBy("title").agg(F.min(F.when(F.col("dst").isNotNull(), F.struct(h.alias("h"), "dst"))).alias("b"))
        moved = go.join(best, "title", "left").select("title", "hops", F.when(F.col("b").isNotNull(), F.concat("path", F.array("b.dst"))).otherwise(F.col("path")).alias("path"), F.col("b").isNull().alias("dead"))
        p = moved.unionByName(stay)
    return p.select("title", "hops", "path", (F.size("path") == F.col("hops") + 1).alias("complete"))


def path_record(path: Column, relations: Column) -> Column:
    """[(title, relation)]: the first with 'image anchor', the last with 'answer', the others with the relation by which they were reached."""
    return F.transform(path, lambda t, i: F.struct(t.alias("title"), F.when(i == 0, "image anchor").when(i == F.size(path) - 1, "answer").otherwise(F.get(relations, i - 1)).alias("relation")))

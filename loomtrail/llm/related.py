"""Problem 4: splits that keep related trajectories together.

Mentions of pages are found by token n-grams against a Bloom filter of fixed greatest size and an exact join with the
names. The graph of trajectories is contracted by random mates: each round every vertex tosses a coin, tails collapse
into a neighbour that shows heads, edges are relabelled by joins, until none is left. The labels are unwound by pointer
jumping over the rounds' tables, and the components are split by their cumulative weight.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize, spread

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")
_P = np.uint64(0x9E3779B97F4A7C15)
MAX_BLOOM_BITS = 27  # 2 ** 27 bits, 16 MB: the greatest size that is ever broadcast
BITS_EACH = 12  # of the filter for each name: with four positions about 6 in 1,000 other n-grams pass
SALTS = 64
HOT_PLACES = 100_000  # a name in fewer places is never hot
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def tokens(text: str) -> list[str]:
    """Words in one spelling: entities and percent signs decoded, no case, no accents, no punctuation."""
    if "&" in text:
        text = html.unescape(text)
    for _ in range(2):
        if "%" in text:
            text = unquote(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _TOKEN.findall(text.casefold())


def _token_hash(t: str, memo: dict[str, int]) -> int:
    h = memo.get(t)
    if h is None:
        if len(memo) > 500_000:
            memo.clear()
        h = memo[t] = xxhash.xxh64_intdigest(t)
    return h


def _name_hash(words: list[str], memo: dict[str, int]) -> int:
    h = 0
    for w in words:
        h = (h * int(_P) + _token_hash(w, memo)) & 0xFFFFFFFFFFFFFFFF
    return h


def page_names(pages: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(name, words, page, hub): the spelling-free names of each page: titles, aliases and the end of its address. Rows with one url are one page; a page is named by its url. A name of a hub and of a page belongs to the hub."""

    @F.pandas_udf("array<struct<name:string,words:int>>")
    def names(titles: pd.Series, urls: pd.Series, aliases: pd.Series) -> pd.Series:
        out = []
        for t, u, a in zip(titles, urls, aliases):
            end = re.split(r"[?#]", u or "")[0].rstrip("/").rsplit("/", 1)[-1]
            got = {}
            for x in [t, end, *(a if a is not None else [])]:
                w = tokens(x) if x else []
                if w:
                    got[" ".join(w)] = len(w)
            out.append([{"name": k, "words": v} for k, v in got.items()])
        return pd.Series(out, dtype=object)

    parts = [pages.select("title", "url", "aliases", F.lit(False).alias("hub"))]
    if hubs is not None:
        parts.append(hubs.select("title", "url", "aliases", F.lit(True).alias("hub")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = every.select("url", "hub", F.explode(names("title", "url", "aliases")).alias("n")).select(F.col("n.name").alias("name"), F.col("n.words").alias("words"), F.col("url").alias("page"), "hub").distinct()
    return named.withColumn("any_hub", F.max("hub").over(Window.partitionBy("name"))).where("hub or not any_hub").drop("any_hub")


def _spots(h: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    """The four positions of hashes in a filter."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) & mask for k in range(4)]


def bloom(names: DataFrame, power: int) -> np.ndarray:
    """A Bloom filter of 2 ** power bits of the names, as 64-bit words."""
    mask = np.uint64((1 << power) - 1)

    @F.pandas_udf("array<bigint>")
    def positions(s: pd.Series) -> pd.Series:
        memo: dict[str, int] = {}
        h = np.array([_name_hash(x.split(" "), memo) for x in s], dtype=np.uint64)
        return pd.Series(list(np.stack(_spots(h, mask), axis=1).astype(np.int64)) if len(h) else [], dtype=object)

    spots = names.select(F.explode(positions("name")).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = np.zeros(1 << max(0, power - 6), dtype=np.uint64)
    got = spots.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (power - 6) rows
    if len(got):
        words[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def ngram_hashes(flat: np.ndarray, n: int, cache: dict) -> np.ndarray:
    """The hash of each run of n token hashes, by prefix sums: any length at the price of one pass."""
    if not cache:
        power = np.multiply.accumulate(np.full(len(flat) + 1, _P, dtype=np.uint64))
        back = np.multiply.accumulate(np.full(len(flat), _INVERSE, dtype=np.uint64))
        cache["sum"] = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(flat * back, dtype=np.uint64)))
        cache["power"] = np.concatenate((np.ones(1, dtype=np.uint64), power))
    total, power = cache["sum"], cache["power"]
    return (total[n:] - total[: len(total) - n]) * power[n : len(flat) + 1]


def _finder(shared, mask: np.uint64, lengths: list[int]):
    """A function on texts that gives the n-grams that pass a filter."""

    @F.pandas_udf("array<struct<at:int,words:int,name:string>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, memo = shared.value, {}

        def hits(h: np.ndarray) -> np.ndarray:
            ok = np.ones(len(h), dtype=bool)
            for p in _spots(h, mask):
                ok &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            return ok

        for s in batches:
            texts = [tokens(x) for x in s]
            counts = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.repeat(np.cumsum(counts), counts)
            starts = np.cumsum(counts) - counts
            flat = np.fromiter((_token_hash(w, memo) for t in texts for w in t), dtype=np.uint64, count=int(counts.sum()))
            owner = np.repeat(np.arange(len(texts)), counts)
            found: list[list[dict]] = [[] for _ in texts]
            cache: dict = {}
            for n in lengths:
                size = len(flat) - n + 1
                if size <= 0:
                    break
                for k in np.nonzero(hits(ngram_hashes(flat, n, cache)) & (np.arange(size) + n <= ends[:size]))[0]:
                    o = owner[k]
                    at = int(k - starts[o])
                    found[o].append({"at": at, "words": n, "name": " ".join(texts[o][at : at + n])})
            yield pd.Series(found, dtype=object)

    return find


def mentions(trajectories: DataFrame, names: DataFrame) -> DataFrame:
    """(traj_id, page, hub) of each page that a trajectory's texts or tool-call arguments name. A name inside a longer one isn't named.

    One filter of at most 2 ** MAX_BLOOM_BITS bits holds 11 million names; more names are cut into as many parts, and the
    texts are read once for each. Names that stand in more than a 20,000th of all places are met by a broadcast of at most
    20,000 of them, the others by a join without hot keys.
    """
    spark = trajectories.sparkSession
    lengths = {int(r["words"]): int(r["n"]) for r in names.groupBy("words").agg(F.count("*").alias("n")).collect()}  # a row for each length
    count = sum(lengths.values())
    passes = -(-count * BITS_EACH // (1 << MAX_BLOOM_BITS)) or 1
    power = min(MAX_BLOOM_BITS, max(12, int(np.ceil(np.log2(max(1, count * BITS_EACH / passes))))))

    @F.pandas_udf("array<string>")
    def strings(s: pd.Series) -> pd.Series:
        def read(x: str | None) -> list[str]:
            try:
                v = json.loads(x)
            except (TypeError, ValueError):
                return [x] if x else []
            out: list[str] = []
            todo = [v]
            while todo:
                v = todo.pop()
                if isinstance(v, str):
                    out.append(v)
                elif isinstance(v, dict):
                    todo += v.values()
                elif isinstance(v, list):
                    todo += v
            return out

        return s.map(read)

    said = trajectories.select("traj_id", F.explode("messages").alias("m"))
    parts = said.select("traj_id", F.explode("m.content").alias("p")).select("traj_id", F.col("p.text").alias("text"))
    calls = said.select("traj_id", F.explode("m.tool_calls").alias("c")).select("traj_id", F.explode(strings("c.function.arguments")).alias("text"))
    texts = spread(parts.unionByName(calls).where("text is not null and text <> ''")).withColumn("no", F.monotonically_increasing_id())
    if passes > 1:
        texts = materialize(texts, "texts")
    hits = None
    for k in range(passes):
        some = names if passes == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == k)
        find = _finder(spark.sparkContext.broadcast(bloom(some, power)), np.uint64((1 << power) - 1), sorted(lengths))
        one = texts.select("traj_id", "no", F.explode(find("text")).alias("f")).select("traj_id", "no", "f.at", (F.col("f.at") + F.col("f.words")).alias("end"), "f.name")
        hits = one if hits is None else hits.unionByName(one)
    hits = materialize(hits, "hits")
    places = hits.count()
    named = names.select("name", "page", "hub")
    if places <= HOT_PLACES:  # then no name can be hot
        real = hits.join(named, "name")
    else:
        hot = F.broadcast(hits.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_PLACES, places // 20_000)).select("name"))
        real = hits.join(hot, "name", "left_anti").join(named, "name").unionByName(hits.join(F.broadcast(named.join(hot, "name", "left_semi")), "name"))
    before = Window.partitionBy("traj_id", "no").orderBy("at", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = real.withColumn("reach", F.max(F.struct("end", F.col("at").alias("from"))).over(before))
    kept = outer.where("reach is null or reach.end < end or (reach.end = end and reach.from = at)")
    return kept.select("traj_id", "page", "hub").distinct()


def components(edges: DataFrame, seed: int = 1, most_rounds: int = 400) -> DataFrame:
    """(v, root) of each vertex of a graph of edges (a, b) that isn't its component's root, by random-mate contraction."""
    spark = edges.sparkSession
    e = materialize(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges-0")
    maps = []
    for k in range(most_rounds):
        if e.isEmpty():
            break
        # heads are likelier where many could collapse; a vertex with one neighbour always shows tails
        heads = f"deg > 1 and pmod(xxhash64(a, {seed * 1000 + k}), 1000) < case when deg >= 8 then 900 when deg >= 4 then 700 else 500 end"
        deg = e.groupBy("a").agg(F.count("*").alias("deg")).withColumn("heads", F.expr(heads))
        seen = e.join(deg.select(F.col("a").alias("b"), F.col("deg").alias("deg_b"), F.col("heads").alias("heads_b")), "b")
        mate = (
            seen.groupBy("a")
            .agg(F.count("*").alias("deg"), F.min(F.expr("case when heads_b then b end")).alias("mate"), F.min("b").alias("one"), F.min("deg_b").alias("deg_b"))
            .withColumn("heads", F.expr(heads))
            .select("a", F.expr("case when deg = 1 and deg_b = 1 then case when one < a then one end when not heads then mate end").alias("p"))
            .where("p is not null")
        )
        m = materialize(mate, f"mates-{k}")
        left = e.join(m, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
        both = left.join(m.select(F.col("a").alias("b"), "p"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        new = materialize(both.where("a <> b").distinct(), f"edges-{k + 1}")
        drop_materialized(spark, e)
        e = new
        maps.append(m)
    else:
        raise RuntimeError("the graph didn't contract")
    if not maps:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    up = maps[0]
    for m in maps[1:]:
        up = up.unionByName(m)
    up = up.select(F.col("a").alias("v"), F.col("p").alias("root"))
    for j in range(int(np.ceil(np.log2(len(maps) + 1)))):
        far = up.select(F.col("v").alias("root"), F.col("root").alias("next"))
        up = materialize(up.join(far, "root", "left").select("v", F.coalesce("next", "root").alias("root")), f"labels-{j}")
    return up


def related_groups(trajectories: DataFrame, pages: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(traj_id, group_id) of each trajectory of a group of two or more; group_id is the smallest traj_id of the group.

    Null messages, texts and arguments name nothing; broken JSON arguments are read as text; pages without a title are
    named by alias and address. An empty table gives no groups. A page named by a third of all trajectories gives a
    star of as many edges, which contracts like any other.
    """
    named = materialize(mentions(trajectories, materialize(page_names(pages, hubs), "names")).where("not hub").select("traj_id", "page"), "mentions")
    # a star for each page and salt, and one of their centres, so that no page is a hot key
    named = named.withColumn("salt", F.pmod(F.xxhash64("traj_id"), F.lit(SALTS)))
    stars = named.groupBy("page", "salt").agg(F.min("traj_id").alias("a"))
    centres = stars.groupBy("page").agg(F.min("a").alias("c"))
    edges = named.join(stars, ["page", "salt"]).select("a", F.col("traj_id").alias("b")).unionByName(stars.join(centres, "page").select(F.col("c").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    up = components(edges)
    low = up.groupBy("root").agg(F.least(F.min("v"), F.first("root")).alias("group_id"))
    return up.join(low, "root").select(F.col("v").alias("traj_id"), "group_id").unionByName(low.select(F.col("root").alias("traj_id"), "group_id"))


def assign_splits(groups: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 7, heavy: float = 0.01) -> DataFrame:
    """(traj_id, group_id, split) from (traj_id, group_id): whole groups, in the given proportions of rows.

    Groups are laid on a line by cumulative weight, and the middle of a group tells its split. Groups of more than the
    share heavy of all rows (at most 1 / heavy of them) come first, by size; the rest in hashed order, by prefix sums
    over blocks and within them, so that no task orders all groups.
    """
    size = groups.groupBy("group_id").agg(F.count("*").alias("w"))
    n = groups.count()
    blocks = max(1, min(4096, n // 2000))
    size = size.withColumn("block", F.when(F.col("w") > heavy * n, F.lit(-1)).otherwise(F.pmod(F.xxhash64("group_id", F.lit(seed)), F.lit(blocks)))).withColumn("h", F.xxhash64("group_id", F.lit(seed + 1)))
    per = size.groupBy("block").agg(F.sum("w").alias("bw"))
    offset = per.withColumn("off", F.sum("bw").over(Window.orderBy("block")) - F.col("bw")).select("block", "off")  # at most 4,097 rows
    inner = Window.partitionBy("block").orderBy(F.expr("case when block = -1 then -w end"), "h", "group_id")
    placed = size.join(F.broadcast(offset), "block").withColumn("mid", (F.col("off") + F.sum("w").over(inner) - F.col("w") / 2) / F.lit(max(1, n)))
    edge, case = 0.0, None
    for name, share in shares[:-1]:
        edge += share
        case = F.when(F.col("mid") < edge, name) if case is None else case.when(F.col("mid") < edge, name)
    case = F.lit(shares[-1][0]) if case is None else case.otherwise(shares[-1][0])
    return groups.join(placed.select("group_id", case.alias("split")), "group_id").select("traj_id", "group_id", "split")


def related_splits(trajectories: DataFrame, pages: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(traj_id, group_id, split) of every trajectory; one that is related to none is a group of its own."""
    g = materialize(related_groups(trajectories, pages, hubs), "groups")
    every = trajectories.select("traj_id").distinct().join(g, "traj_id", "left").select("traj_id", F.coalesce("group_id", "traj_id").alias("group_id"))
    return assign_splits(materialize(every, "grouped"))

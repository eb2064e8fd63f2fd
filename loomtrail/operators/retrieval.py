"""Retrieval: term search, result lists, caches, providers that fall back, retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, spread

MOST_RESULTS = 10
QUERY_BLOCK = 20_000
CACHE_TTL = 7 * 24 * 3600


def terms(text: Column) -> Column:
    """Distinct normalised words; an empty array for null."""
    n = F.coalesce(T.normalise(text), F.lit(""))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(n, " ")))


def term_search(queries: DataFrame, documents: DataFrame, k: int, query_key: str, query_text: str, doc_key: str, doc_text: str) -> DataFrame:
    """(query_key, doc_key, hits, rank): the k documents that share most words with each query, ties by key; k within 1 and 10; a document counts once per word.

    The queries are a stated set and go to the tasks in blocks of QUERY_BLOCK; the documents pass by once a block, and a
    task keeps the best k of each query. So a word that stands in all documents is no hot key, and what is shuffled is
    at most k rows for each query and task.
    """
    k = max(1, min(MOST_RESULTS, k))
    q = queries.select(query_key, terms(F.col(query_text)).alias("terms")).where("size(terms) > 0")
    d = documents.select(doc_key, terms(F.col(doc_text)).alias("terms")).where("size(terms) > 0")
    few = q.limit(QUERY_BLOCK + 1).collect()
    blocks = 1 if len(few) <= QUERY_BLOCK else -(-q.count() // QUERY_BLOCK)
    d = materialize(d, "terms") if blocks > 1 else spread(d)
    kind = {f.name: f.dataType.simpleString() for f in (*q.schema, *d.schema)}
    best = None
    for b in range(blocks):
        index: dict[str, list] = {}
        for r in few if blocks == 1 else q.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).collect():  # QUERY_BLOCK rows or so
            for w in r["terms"]:
                index.setdefault(w, []).append(r[query_key])
        hit = d.mapInPandas(_searcher(documents.sparkSession.sparkContext.broadcast(index), k, query_key, doc_key), f"`{query_key}` {kind[query_key]}, `{doc_key}` {kind[doc_key]}, hits bigint")
        best = hit if best is None else best.unionByName(hit)
    w = Window.partitionBy(query_key).orderBy(F.col("hits").desc(), doc_key)
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select(query_key, doc_key, "hits", "rank")


def _searcher(shared, k: int, query_key: str, doc_key: str):
    """The best k documents of a task for each query."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        top: dict = {}

        def cut(rows: list) -> list:
            rows.sort(key=lambda r: (-r[0], r[1]))
            return rows[:k]

        for pdf in batches:
            for doc, words in zip(pdf[doc_key].tolist(), pdf["terms"]):
                hits: dict = {}
                for w in words:
                    for q in index.get(w, ()):
                        hits[q] = hits.get(q, 0) + 1
                for q, n in hits.items():
                    rows = top.setdefault(q, [])
                    rows.append((n, doc))
                    if len(rows) > 64 * k:
                        top[q] = cut(rows)
        found = [(q, doc, n) for q, rows in top.items() for n, doc in cut(rows)]
        yield pd.DataFrame(found, columns=[query_key, doc_key, "hits"])

    return search


def result_list(items: DataFrame, key: str, query: str, rank: str = "rank") -> DataFrame:
    """(key, listing): the results of a query as numbered text; items hold title, link, snippet."""
    t = F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.lit("Untitled"))
    line = F.concat(F.col(rank).cast("string"), F.lit(". "), t, F.lit("\n   "), T.strip(F.col("link")), F.lit("\n   "), T.strip(F.col("snippet")))
    g = items.groupBy(key, query).agg(F.sort_array(F.collect_list(F.struct(rank, line.alias("line")))).alias("ls"))
    return g.select(key, F.concat(F.lit("Search results for: "), F.col(query), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("listing"))


def rss_items(xml: Column, k: int = MOST_RESULTS) -> Column:
    """Items of an RSS text: array of (title, link, snippet), the first k; markup cut from the snippet."""
    items = F.slice(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), 1), 1, max(1, min(MOST_RESULTS, k)))
    get = lambda x, tag: F.regexp_extract(x, rf"(?s)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)

    def plain(c: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(char))
        return c

    return F.transform(items, lambda x: F.struct(T.strip(plain(get(x, "title"))).alias("title"), T.strip(get(x, "link")).alias("link"), T.squeeze(F.regexp_replace(plain(get(x, "description")), r"<[^>]+>", " ")).alias("snippet")))


def first_non_empty(*lists: Column, most: int = MOST_RESULTS) -> Column:
    """The first list that isn't empty, at most `most` items; an empty list if all are."""
    return F.slice(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], lists[0]), 1, most)


def latest(cache: DataFrame, keys: list[str], at: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The last write of each key."""
    rest = [c for c in cache.columns if c not in keys]
    order = F.struct(at, tie) if tie else F.col(at)
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def live(cache: DataFrame, now: Column, ttl: float = CACHE_TTL, at: str = "updated_at") -> DataFrame:
    """Entries no older than ttl seconds at the time now."""
    return cache.where(~(now - F.col(at) > ttl))


def upsert(cache: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """cache with new rows put in: the last write of each key stays."""
    return latest(cache.unionByName(new), keys, at)


def lookup(requests: DataFrame, cache: DataFrame, keys: list[str], value: str, filled: Column) -> DataFrame:
    """requests with value and hit: what the cache holds, else the filled column."""
    j = requests.join(cache.select(*keys, F.col(value).alias("_v")), keys, "left")
    return j.withColumn("hit", F.col("_v").isNotNull()).withColumn(value, F.coalesce("_v", filled)).drop("_v")


def fallback(providers: list[tuple[str, Column, Column]], pinned: str | None = None) -> Column:
    """(content, provider, error) of the first provider with a content; providers are (name, content, error), in their order, or the pinned one alone. If all fail, error joins what they reported and content is null."""
    use = [p for p in providers if pinned is None or p[0] == pinned]
    ok = lambda c: F.coalesce(c, F.lit("")) != ""
    name = F.coalesce(*[F.when(ok(c), F.lit(n)) for n, c, _ in use])
    errors = F.array_join(F.array(*[F.concat(F.lit(f"{n}: "), F.coalesce(e, F.lit("empty"))) for n, _, e in use]), "; ")
    return F.struct(F.coalesce(*[F.when(ok(c), c) for _, c, _ in use]).alias("content"), name.alias("provider"), F.when(name.isNull(), F.concat(F.lit("all configured page readers failed: "), errors)).alias("error"))


def retries(attempts: DataFrame, call: str, order: list[str], ok: str, retryable: str, most: int = 2) -> DataFrame:
    """(call, attempts, succeeded): attempts made until the first success, a failure that may not be tried again, or `most`."""
    w = Window.partitionBy(call).orderBy(*order)
    a = attempts.withColumn("no", F.row_number().over(w).cast("bigint"))
    stop = F.col(ok) | ~F.col(retryable) | (F.col("no") >= most)
    end = a.where(stop).groupBy(call).agg(F.min_by(F.struct("no", ok), "no").alias("e"))
    n = a.groupBy(call).agg(F.count("*").alias("n"))
    return n.join(end, call, "left").select(call, F.coalesce("e.no", "n").alias("attempts"), F.coalesce(F.col(f"e.{ok}"), F.lit(False)).alias("succeeded"))


def sticky(rows: DataFrame, by: str, order: list[str], flag: str) -> DataFrame:
    """rows with tripped: whether flag was true on an earlier row of the group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("tripped", F.coalesce(F.max(F.coalesce(F.col(flag), F.lit(False))).over(w), F.lit(False)))

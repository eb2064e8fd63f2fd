"""Problem 1: evaluation trajectories that also occur among the training ones.

The heads of evaluation records (question and answer in canonical form) are put into shards of a compressed full-text
index, once, in the shared folder. All heads of training records stream through the shards by backward search from mark
to mark, which goes on with alike words of the shard where a word may be misspelt.
Tool results of the pairs so found go through the same kind of index: all runs of five words are located, occurrences on
one diagonal are merged into maximal matches, and the share of both records that the matches cover tells whether they
took the same course.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize, spread
from .fmindex import RunIndex

SEED = 5  # words: the shortest match that counts
LEAST_SHARE = 0.5
EVAL_WORDS, TRAIN_WORDS, SHARD_WORDS = 200_000, 800_000, 1_000_000  # of tool results, in a block and a shard: what one task holds
HEAD_WORDS, HEAD_BLOCK = 2_000_000, 250_000  # of heads in a shard of the index (at most 28 bytes a word), and of a block that streams through it
OCCURRENCES = 4_000_000  # located at once: a bound on memory, not on what is found
MARK = "\x01"  # between question and answer

_THOUSANDS = re.compile(r"(?<=\d)[,'’    ](?=\d{3}(?!\d))")
_WORD = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"^\s*[\w' ]{1,40}?[:.!?]\s+(?=\S)")
_LABEL = re.compile(r"^\s*(?:[\w']+ ){0,2}[\w']+:\s*")
# How an answer may be framed.
FRAMES = re.compile(r"^(?:so |thus |therefore )?(?:(?:the |my )?(?:final )?answer(?: is)?|based on the page that was read it is|according to the (?:page|source) it is|it is)\b | as stated in the (?:\w+ )?(?:source|page)$")


def words(text: str) -> list[str]:
    """Words in canonical form: no case, no punctuation, no separators of thousands."""
    t = unicodedata.normalize("NFKC", _THOUSANDS.sub("", text)).casefold()
    return _WORD.findall(_THOUSANDS.sub("", t))


def question_core(text: str) -> str:
    """The question without greetings and labels before it."""
    t = text.strip()
    while (m := _LEAD.match(t)) and len(m.group().split()) <= 6 and len(t[m.end() :].split()) >= 4:
        t = t[m.end() :]
    return " ".join(words(t))


def answer_core(text: str) -> str:
    """The answer without labels and frames around it; '' for none."""
    t = text.strip()
    while m := _LABEL.match(t):
        if not t[m.end() :].strip():
            break
        t = t[m.end() :]
    c = " ".join(words(t))
    while (d := FRAMES.sub("", c)) != c and d:
        c = d
    return c


def edits_allowed(words: int) -> int:
    """How many words of a head may be edited."""
    return 0 if words < 8 else 1 if words < 16 else 2


def _near(a: str, b: str) -> bool:
    """Whether a and b differ by one letter: changed, left out, put in, or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def alike(a: str, b: str) -> bool:
    """Whether two different words may be one, misspelt: five letters or more, no figures, one letter apart."""
    return a != b and min(len(a), len(b)) >= 5 and not any(c.isdigit() for c in a + b) and _near(a, b)


def same_head(a: list[str], b: list[str]) -> bool:
    """Whether two heads are one within the allowed edits. The plain model of what the index finds."""
    if len(a) != len(b):
        return False
    other = [(x, y) for x, y in zip(a, b) if x != y]
    return len(other) <= edits_allowed(len(a)) and all(alike(x, y) for x, y in other)


def alike_words(words_: list[str], vocabulary: list[str]) -> list[list[int]]:
    """The places in vocabulary of the words alike each of words_: those that share a form with one letter left out are compared."""
    shorter = lambda w: {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}
    fit = lambda w: len(w) >= 5 and not any(c.isdigit() for c in w)
    forms: dict[str, list[int]] = {}
    for k, w in enumerate(vocabulary):
        if fit(w):
            for f in shorter(w):
                forms.setdefault(f, []).append(k)
    return [sorted({k for f in shorter(w) for k in forms.get(f, ()) if alike(w, vocabulary[k])}) if fit(w) else [] for w in words_]


def head_shard(heads: list[str]) -> tuple[bytes, np.ndarray, list[str]]:
    """The packed index of heads (words between blanks) with a mark that no head holds around each; the place of the mark before each; the words by their symbols from 1."""
    texts = [h.split(" ") for h in heads]
    vocabulary = sorted({w for t in texts for w in t})
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    size = np.array([len(t) for t in texts], dtype=np.int64)
    marks = np.cumsum(size + 1) - (size + 1)
    flat = np.fromiter((v for t in texts for v in (0, *[number[w] for w in t])), dtype=np.int64, count=int((size + 1).sum()))
    return RunIndex(np.concatenate((flat, [0]))).pack(), marks, vocabulary


def head_matches(index: RunIndex, marks: np.ndarray, vocabulary: list[str], heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position in heads, number of an indexed head): all pairs that are one head within the allowed edits.

    All heads are read backwards at once. A search is an interval of the index; where a word may be misspelt, it goes on
    with each alike word of the shard, too, one edit fewer left. Searches whose interval is empty end; those that reach
    the mark before a head have met it whole.
    """
    texts = [h.split(" ") for h in heads]
    mine = sorted({w for t in texts for w in t})
    number = {w: k for k, w in enumerate(mine)}
    known = {w: k for k, w in enumerate(vocabulary, 1)}
    symbol = index.dense(np.array([known.get(w, -2) for w in mine], dtype=np.int64))
    near = alike_words(mine, vocabulary)
    count = np.array([len(x) for x in near], dtype=np.int64)
    first = np.cumsum(count) - count
    others = index.dense(np.array([k + 1 for x in near for k in x], dtype=np.int64))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    flat = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(size.sum()))
    mark = index.dense(np.zeros(1, dtype=np.int64))[0]
    own, left, edits = np.arange(len(texts)), size.copy(), np.array([edits_allowed(int(n)) for n in size], dtype=np.int64)
    low, high = index.step(np.zeros(len(own), dtype=np.int64), np.full(len(own), index.n, dtype=np.int64), np.full(len(own), mark))
    out = []
    while len(own):
        w = flat[begin[own] + left - 1]
        more = np.where(edits > 0, count[w], 0)
        src = np.repeat(np.arange(len(own)), more)
        k = np.arange(len(src)) - np.repeat(np.cumsum(more) - more, more) + first[w][src]
        take = np.concatenate((np.arange(len(own)), src))
        c = np.concatenate((symbol[w], others[k]))
        spent = np.concatenate((np.zeros(len(own), dtype=np.int64), np.ones(len(src), dtype=np.int64)))
        low, high = index.step(low[take], high[take], c)
        own, left, edits = own[take], left[take] - 1, edits[take] - spent
        ok = high > low
        own, left, edits, low, high = own[ok], left[ok], edits[ok], low[ok], high[ok]
        end = left == 0
        if end.any():
            a, b = index.step(low[end], high[end], np.full(int(end.sum()), mark))
            which, place = index.locate(a, b)
            out.append(np.unique(own[end][which] * np.int64(len(marks)) + np.searchsorted(marks, place)))
            own, left, edits, low, high = own[~end], left[~end], edits[~end], low[~end], high[~end]
    pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
    return pairs // max(1, len(marks)), pairs % max(1, len(marks))


def match_share(evals: list[list[int]], trains: list[list[int]], eval_group: np.ndarray, train_group: np.ndarray, seed: int = SEED) -> pd.DataFrame:
    """(train, eval, spans, covered, share) of each pair of one group with a match of seed words: by positions in the lists. covered is the number of the training record's words within maximal matches; share relates it to the longer record."""
    pad = -2
    # records begin with seed marks, so that short and empty ones can match, too
    ev = [np.concatenate((np.full(seed, pad), np.asarray(x, dtype=np.int64))) for x in evals]
    tr = [np.concatenate((np.full(seed, pad), np.asarray(x, dtype=np.int64))) for x in trains]
    vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *ev, *tr]))
    width = len(vocabulary) + 2
    symbol = lambda seqs, groups: np.concatenate([np.zeros(0, dtype=np.int64), *[np.searchsorted(vocabulary, x) + 1 + int(g) * width for x, g in zip(seqs, groups)]])
    e_len, t_len = np.array([len(x) for x in ev], dtype=np.int64), np.array([len(x) for x in tr], dtype=np.int64)
    # a symbol that no record holds after each one, so that no match runs on into the next
    flat = symbol(ev, eval_group)
    mark = (int(max(eval_group, default=0)) + int(max(train_group, default=0)) + 2) * width
    text = np.insert(flat, np.cumsum(e_len), mark) if len(ev) else flat
    starts = np.cumsum(e_len + 1) - (e_len + 1)
    index = RunIndex(text)
    query = index.dense(symbol(tr, train_group))
    begin = np.cumsum(t_len) - t_len
    ends = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(b + seed, b + n + 1) for b, n in zip(begin, t_len)]])
    alive, low, high = index.search(query, ends, np.full(len(ends), seed))
    # a few million occurrences at a time, whole training records each
    owner = np.searchsorted(begin, ends[alive] - seed, side="right") - 1
    load = np.cumsum(np.bincount(owner, weights=high - low, minlength=len(tr)))
    chunk = (load // OCCURRENCES).astype(np.int64)[owner] if len(owner) else owner
    parts = [_merge(index, low[a], high[a], ends[alive[a]], begin, starts, t_len, e_len, seed) for c in np.unique(chunk) for a in [chunk == c]]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"train": [], "eval": [], "spans": [], "covered": [], "share": []})


def _merge(index: RunIndex, low: np.ndarray, high: np.ndarray, ends: np.ndarray, begin: np.ndarray, starts: np.ndarray, t_len: np.ndarray, e_len: np.ndarray, seed: int) -> pd.DataFrame:
    """The rows of match_share for intervals of seeds: occurrences located, put on their diagonals, and merged into maximal matches."""
    which, at = index.locate(low, high)
    e = np.searchsorted(starts, at, side="right") - 1
    q = ends[which] - seed
    t = np.searchsorted(begin, q, side="right") - 1
    q, at = q - begin[t], at - starts[e]
    diagonal = at - q
    order = np.lexsort((q, diagonal, e, t))
    t, e, q, diagonal = t[order], e[order], q[order], diagonal[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (e[1:] != e[:-1]) | (diagonal[1:] != diagonal[:-1]) | (q[1:] > q[:-1] + 1))) if len(t) else np.zeros(0, dtype=bool)
    head = np.nonzero(new)[0]
    tail = np.concatenate((head[1:], [len(t)])) - 1 if len(head) else head
    spans = pd.DataFrame({"train": t[head], "eval": e[head], "a": q[head], "b": q[tail] + seed})
    # union of the spans of a pair on the training record
    spans = spans.sort_values(["train", "eval", "a", "b"], kind="stable")
    reach = spans.groupby(["train", "eval"])["b"].cummax().groupby([spans["train"], spans["eval"]]).shift(fill_value=0)
    spans["covered"] = np.maximum(0, spans["b"] - np.maximum(spans["a"], reach))
    out = spans.groupby(["train", "eval"], as_index=False).agg(spans=("a", "size"), covered=("covered", "sum"))
    out["share"] = out["covered"] / np.maximum(t_len[out["train"].to_numpy()], e_len[out["eval"].to_numpy()])
    return out


def records(trajectories: DataFrame) -> DataFrame:
    """(traj_id, is_eval, split, dataset, head, key, body, h): the canonical parts of each record that has a split. head holds the words of question and answer with a mark between, body those of the tool results; key and h are their MD5."""
    text = lambda role: F.expr(
        f"array_join(flatten(transform(filter(coalesce(messages, array()), m -> m.role = '{role}'), m -> transform(filter(coalesce(m.content, array()), p -> p.text is not null), p -> p.text))), '\\n')"
    )

    @F.pandas_udf("head string, body string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, t, a in batches:
            heads = [" ".join(x for x in (question_core(x or ""), MARK, answer_core(y or "")) if x) for x, y in zip(q, a)]
            yield pd.DataFrame({"head": heads, "body": [" ".join(words(x or "")) for x in t]})

    t = spread(trajectories.where("split is not null").select("traj_id", "split", "dataset", text("user").alias("q"), text("tool").alias("t"), "final_answer"))
    r = t.select("traj_id", "split", "dataset", read("q", "t", "final_answer").alias("r"))
    return r.select("traj_id", (F.col("split") != "train").alias("is_eval"), "split", "dataset", "r.head", F.md5("r.head").alias("key"), "r.body", F.md5("r.body").alias("h"))


def _word_count(column: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(" "), F.lit(""))) + 1


def head_pairs(every: DataFrame) -> DataFrame:
    """(eval_key, train_key) of the heads of evaluation and training records that are one within the allowed edits, found by the index. A table in the shared folder.

    Each different head is met once. Blocks of training heads meet each shard of the index: evaluation heads are a stated
    query set, and heads are all of a record that is sent so.
    """
    heads = materialize(every.groupBy("is_eval", "key").agg(F.min("head").alias("head")), "heads")
    size = {r["is_eval"]: int(r["n"]) for r in heads.groupBy("is_eval").agg(F.sum(_word_count("head")).alias("n")).collect()}
    cores = heads.sparkSession.sparkContext.defaultParallelism
    shards, blocks = size.get(True, 0) // HEAD_WORDS + 1, max(size.get(False, 0) // HEAD_BLOCK + 1, cores)
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n).cast("bigint"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        packed, marks, vocabulary = head_shard(pdf["head"].tolist())
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "index": [packed], "marks": [marks], "words": [vocabulary], "keys": [pdf["key"].tolist()]})

    evals = heads.where("is_eval").withColumn("shard", part(shards))
    index = materialize(evals.groupBy("shard").applyInPandas(build, "shard bigint, index binary, marks array<bigint>, words array<string>, keys array<string>"), "index")

    def stream(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"eval_key": pd.Series(dtype=str), "train_key": pd.Series(dtype=str)})
        s = shard.iloc[0]
        t, e = head_matches(RunIndex.unpack(s["index"]), np.asarray(s["marks"]), list(s["words"]), block["head"].tolist())
        return pd.DataFrame({"eval_key": np.asarray(s["keys"], dtype=object)[e], "train_key": block["key"].to_numpy(dtype=object)[t]})

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = heads.where("not is_eval").withColumn("block", part(blocks).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).groupBy("shard", "block")
    out = materialize(left.cogroup(right).applyInPandas(stream, "eval_key string, train_key string"), "heads-met")
    for t in (heads, index):
        drop_materialized(out.sparkSession, t)
    return out


def text_pairs(trajectories: DataFrame, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). pairs: (eval_key, eval_h, train_key, train_h, spans, share) of each pair of different texts that are the same record; members: (traj_id, is_eval, split, dataset, key, h), the text of each record that may have a pair. Tables in the shared folder.

    Records of equal canonical text are matched once. The texts of one evaluation head and the training heads that it
    meets are cut into blocks of bounded size on both sides, and each pair of blocks meets in one shard, so that a hot
    group is spread.
    """
    every = materialize(records(trajectories), "records")
    met = head_pairs(every)
    keys = met.select(F.col("eval_key").alias("key"), F.lit(True).alias("is_eval")).unionByName(met.select(F.col("train_key").alias("key"), F.lit(False).alias("is_eval"))).distinct()
    shared = materialize(every.join(keys, ["key", "is_eval"], "left_semi").drop("head"), "shared")
    drop_materialized(shared.sparkSession, every)
    reps = materialize(shared.groupBy("key", "h", "is_eval").agg(F.min("body").alias("body")).withColumn("n", _word_count("body")), "texts")
    ev = reps.where("is_eval").withColumn("eval_key", F.col("key"))
    tr = reps.where("not is_eval").join(met.withColumnRenamed("train_key", "key"), "key")
    both = ev.select("eval_key", "key", "h", "is_eval", "body", "n").unionByName(tr.select("eval_key", "key", "h", "is_eval", "body", "n"))
    size = both.groupBy("eval_key").agg(F.sum(F.expr("case when is_eval then n end")).alias("ne"), F.sum(F.expr("case when not is_eval then n end")).alias("nt"))
    blocks = size.select("eval_key", F.ceil(F.col("ne") / EVAL_WORDS).alias("eb"), F.ceil(F.col("nt") / TRAIN_WORDS).alias("tb"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    shards = max(12, total // SHARD_WORDS + 1)
    mine = F.xxhash64("key", "h")
    spread_ = (
        both.join(blocks, "eval_key")
        .withColumn("e", F.explode(F.when(F.col("is_eval"), F.array(F.pmod(mine, "eb"))).otherwise(F.expr("sequence(0L, eb - 1)"))))
        .withColumn("t", F.explode(F.when(F.col("is_eval"), F.expr("sequence(0L, tb - 1)")).otherwise(F.array(F.pmod(mine, "tb")))))
        .select("eval_key", "e", "t", "key", "h", "is_eval", "body", F.pmod(F.xxhash64("eval_key", "e", "t"), F.lit(shards)).alias("shard"))
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids: dict[str, int] = {}
        numbers = lambda s: [[ids.setdefault(w, len(ids)) for w in x.split()] for x in s]
        group = pdf.groupby(["eval_key", "e", "t"], sort=False).ngroup().to_numpy()
        side = pdf["is_eval"].to_numpy(dtype=bool)
        ev, tr = pdf[side], pdf[~side]
        got = match_share(numbers(ev["body"]), numbers(tr["body"]), group[side], group[~side])
        got = got[got["share"] >= least_share]
        t, e = got["train"].to_numpy(dtype=np.int64), got["eval"].to_numpy(dtype=np.int64)
        of = lambda p, c, k: p[c].to_numpy(dtype=object)[k]
        return pd.DataFrame({"eval_key": of(ev, "key", e), "eval_h": of(ev, "h", e), "train_key": of(tr, "key", t), "train_h": of(tr, "h", t), "spans": got["spans"].to_numpy(dtype=np.int64), "share": got["share"].to_numpy(dtype=float)})

    pairs = spread_.groupBy("shard").applyInPandas(search, "eval_key string, eval_h string, train_key string, train_h string, spans bigint, share double")
    pairs = materialize(pairs, "matches")
    for t in (met, reps):
        drop_materialized(pairs.sparkSession, t)
    return pairs, shared.select("traj_id", "is_eval", "split", "dataset", "key", "h")


def overlaps(trajectories: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(train_id, eval_id, share) of each pair that is the same record, copies of one text expanded.

    Records without a split take no part; null messages, contents, texts and answers count as empty. Heads of fewer than 8
    words must be equal, those of fewer than 16 may have one misspelt word, longer ones two.
    """
    pairs, members = text_pairs(trajectories, least_share)
    train = members.where("not is_eval").select(F.col("key").alias("train_key"), F.col("h").alias("train_h"), F.col("traj_id").alias("train_id"))
    evals = members.where("is_eval").select(F.col("key").alias("eval_key"), F.col("h").alias("eval_h"), F.col("traj_id").alias("eval_id"))
    return pairs.join(train, ["train_key", "train_h"]).join(evals, ["eval_key", "eval_h"]).select("train_id", "eval_id", "share")


def overlap_report(trajectories: DataFrame) -> DataFrame:
    """(split, dataset, records, overlapping, pairs) of each evaluation split and source. Copies are counted, not expanded."""
    pairs, members = text_pairs(trajectories)
    copies = members.where("not is_eval").groupBy(F.col("key").alias("train_key"), F.col("h").alias("train_h")).agg(F.count("*").alias("c"))
    n = pairs.join(copies, ["train_key", "train_h"]).groupBy(F.col("eval_key").alias("key"), F.col("eval_h").alias("h")).agg(F.sum("c").alias("n"))
    o = members.where("is_eval").join(n, ["key", "h"]).select("traj_id", "n")
    e = trajectories.where("split <> 'train'").select("traj_id", "split", "dataset").join(o, "traj_id", "left")
    return e.groupBy("split", "dataset").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))

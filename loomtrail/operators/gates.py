"""Quality gates: ordered reasons, strict verdicts, leaks of hidden names, attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, spread

# The keys of a quality verdict.
VERDICTS = ["answer_invariant", "unique_entity_path", "no_alias_leakage", "source_anchor_only", "visually_grounded", "needs_external_tools", "not_solved_by_one_reverse_image_search", "nontrivial"]
MOST_NAME_BYTES = 32 * 1024 * 1024


def answer_reason(question: Column, answer: Column) -> Column:
    """Why a question and its answer are refused, null if they aren't; the first reason counts."""
    # fixed values: the reasons
    bare = F.regexp_replace(T.fold(F.coalesce(answer, F.lit(""))), r"^[ .]+|[ .]+$", "")
    return (
        F.when((T.strip(question) == "") | (T.strip(answer) == ""), "empty question or answer")
        .when(T.word_count(answer) > 6, "answer exceeds six tokens")
        .when(bare.isin(T.GENERIC_ANSWERS), "answer is generic")
        .when(~F.contains(T.fold(question), F.lit("image")), "source anchor is not visual")
    )


def all_true(columns: list[Column]) -> Column:
    """Whether every verdict is exactly true; a null one refuses."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(c, F.lit(False))
    return out


def all_false(columns: list[Column]) -> Column:
    """Whether every flag is exactly false; a null one refuses."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~c, F.lit(False))
    return out


def process_accepted(accepted: Column, no_redundant: Column, score: Column, least: float = 0.6) -> Column:
    """Accepted, without redundant searches, and a score of at least `least`; a missing score is 0."""
    return F.coalesce(accepted, F.lit(False)) & F.coalesce(no_redundant, F.lit(False)) & (F.coalesce(score, F.lit(0.0)) >= least)


def leaked(question: Column, hidden: Column) -> Column:
    """Whether a normalised question contains a non-empty normalised hidden name (as a substring, not as words)."""
    q = T.normalise(F.coalesce(question, F.lit("")))
    return F.exists(hidden, lambda h: (F.coalesce(T.normalise(h), F.lit("")) != "") & F.contains(q, T.normalise(h)))


def leaks(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name) of each text that contains a name, both normalised. Containment knows no equi join: an automaton of all names reads each text once. Names go to the tasks in parts of at most MOST_NAME_BYTES, and more parts than one read the normalised texts as often."""
    n = names.select(F.col(name).alias("name"), T.normalise(F.col(name)).alias("norm")).where("norm <> ''").distinct()
    size = n.agg(F.sum(F.octet_length("norm") + F.octet_length("name")).alias("b")).first()["b"] or 0
    parts = int(size // MOST_NAME_BYTES) + 1
    q = texts.select(key, T.normalise(F.col(text)).alias("q")).where("q <> ''")
    q = materialize(q, "normal") if parts > 1 else spread(q)
    sc = texts.sparkSession.sparkContext
    out = None
    for b in range(parts):
        part = n if parts == 1 else n.where(F.pmod(F.xxhash64("norm"), F.lit(parts)) == b)
        words: dict[str, list[str]] = {}
        for r in part.collect():  # at most about MOST_NAME_BYTES, as counted
            words.setdefault(r["norm"], []).append(r["name"])
        hit = q.select(key, F.explode(_contained(sc.broadcast(words))("q")).alias("name"))
        out = hit if out is None else out.unionByName(hit)
    return out


def _contained(shared):
    """A function that gives the names that a text contains, each once."""

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for norm, said in shared.value.items():
            automaton.add_word(norm, said)
        ready = len(automaton) > 0
        if ready:
            automaton.make_automaton()
        for s in batches:
            yield pd.Series([sorted({x for _, said in automaton.iter(q) for x in said}) if ready else [] for q in s], dtype=object)

    return find


def quality(question: Column, hidden: Column, answer: Column, verdicts: dict[str, Column]) -> Column:
    """Whether a question passes all VERDICTS strictly. no_alias_leakage is told by the deterministic check over hidden names and the answer, whatever a judge says of it; a verdict that is missing or null refuses."""
    clean = ~F.coalesce(leaked(question, F.concat(F.coalesce(hidden, F.array().cast("array<string>")), F.array(answer))), F.lit(False))
    return all_true([clean if k == "no_alias_leakage" else verdicts.get(k, F.lit(None).cast("boolean")) for k in VERDICTS])


def first_accepted(attempts: DataFrame, sample: str, order: list[str], accepted: str) -> DataFrame:
    """The first accepted attempt of each sample; samples without one are left out."""
    a = attempts.where(F.coalesce(F.col(accepted), F.lit(False)))
    return a.groupBy(sample).agg(F.min_by(F.struct(*[c for c in a.columns if c != sample]), F.struct(*order)).alias("_r")).select(sample, "_r.*")


def avoid_lists(attempts: DataFrame, sample: str, order: list[str], answer: str, accepted: str) -> DataFrame:
    """attempts with avoid: the answers of the sample's refused attempts before each one, in order."""
    w = Window.partitionBy(sample).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("avoid", F.collect_list(F.when(~F.coalesce(F.col(accepted), F.lit(False)), F.col(answer))).over(w))


def audit(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """rows with status and stage: rejected at the first check that isn't true, else accepted with a null stage."""
    stage = None
    for name, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        stage = F.when(bad, name) if stage is None else stage.when(bad, name)
    out = rows.withColumn("stage", stage if stage is not None else F.lit(None).cast("string"))
    return out.withColumn("status", F.when(F.col("stage").isNull(), "accepted").otherwise("rejected"))

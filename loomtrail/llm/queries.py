"""The pN_ queries and, where SQL can say it, their equivalents for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import boilerplate, encode, mixing, overlap, related, residue, subset, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_a, traj_b of each train and evaluation trajectory that are the same record."""
    o = overlap.overlaps(table(spark, sf_dir, "trajectories"))
    return o.select(F.least("train_id", "eval_id").alias("traj_a"), F.greatest("train_id", "eval_id").alias("traj_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and dataset."""
    return overlap.overlap_report(table(spark, sf_dir, "trajectories"))


def p2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages chosen for each row of subset_requests."""
    return subset.varied_subsets(table(spark, sf_dir, "page_nodes"), table(spark, sf_dir, "subset_requests"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request got."""
    return subset.subset_report(table(spark, sf_dir, "page_nodes"), table(spark, sf_dir, "subset_requests"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id of each message with residue instead of content."""
    return residue.residue(table(spark, sf_dir, "sft_messages")).select("message_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue by tool or role and by reason."""
    return residue.residue_report(table(spark, sf_dir, "sft_messages"))


def p3_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and fillers that recur, with the number of messages and sources."""
    return residue.stock_texts(table(spark, sf_dir, "sft_messages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, group_id of each trajectory of a group of two or more."""
    return related.related_groups(table(spark, sf_dir, "trajectories"), table(spark, sf_dir, "page_nodes"), table(spark, sf_dir, "hub_pages"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, group_id, split of every trajectory, at 80, 10 and 10 percent."""
    return related.related_splits(table(spark, sf_dir, "trajectories"), table(spark, sf_dir, "page_nodes"), table(spark, sf_dir, "hub_pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache_id, line_no of each line of a page that isn't main body."""
    return boilerplate.boilerplate_lines(table(spark, sf_dir, "tool_cache"))


def p5_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache_id, body: each page with its main body alone."""
    return boilerplate.main_body(table(spark, sf_dir, "tool_cache"))


def p5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested classes of each site's template."""
    return boilerplate.template_report(table(spark, sf_dir, "tool_cache"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document by byte_bpe_50k, without special tokens."""
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, copies of each document of the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each source, at the size of the corpus."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the largest size at which every source with documents has its target share."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total="exact")


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, shares and residuals of the sources, languages and topics that the weights were raked to."""
    return mixing.margin_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each document whose text was cut."""
    return truncation.cut_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each source."""
    return truncation.truncation_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_subset": p2_subset,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_stock": p3_stock,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p5_found": p5_found,
    "p5_body": p5_body,
    "p5_templates": p5_templates,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_exact_shares": p7_exact_shares,
    "p7_margins": p7_margins,
    "p8_found": p8_found,
    "p8_report": p8_report,
}

ORACLE: dict[str, str] = {}

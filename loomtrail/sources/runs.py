"""Files of agent runs: contracts, training logs, checkpoints, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "version string, maxTurns int, toolTimeoutMs int, tools array<string>"


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """One row of a tool contract in JSON, with a column problem: limits must be positive, tools named, each once."""
    c = spark.read.schema(CONTRACT).option("multiLine", True).json(path)
    problem = (
        F.when(F.coalesce("maxTurns", F.lit(0)) <= 0, "maxTurns must be positive")
        .when(F.coalesce("toolTimeoutMs", F.lit(0)) <= 0, "toolTimeoutMs must be positive")
        .when(F.coalesce(F.size("tools"), F.lit(0)) <= 0, "tools must be a non-empty list")
        .when(F.exists("tools", lambda t: F.coalesce(t, F.lit("")) == ""), "a tool has no name")
        .when(F.size(F.array_distinct("tools")) != F.size("tools"), "tools must be unique")
    )
    return c.withColumn("problem", problem)


def last_checkpoint(spark: SparkSession, folder: str, name: str = "trainer_state.json") -> DataFrame:
    """One row: the last path, by name, of the complete checkpoints of a run; null if there is none."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    return f.where(F.col("path").rlike(r"/checkpoint-[^/]+/[^/]+$")).agg(F.max("path").alias("path"))


def load_split(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A training split in JSON Lines; a required column that no row fills is an error."""
    rows = spark.read.schema(schema).json(path)
    missing = [c for c in required if c not in rows.columns]
    if not missing:
        filled = rows.agg(*[F.count(c).alias(c) for c in required]).first()
        missing = [c for c in required if not filled[c]]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def read_images(spark: SparkSession, path: str, most_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """(path, length, content, problem) of image files; content is null beyond the size that is allowed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    over = F.col("length") > most_bytes
    return f.select("path", "length", F.when(~over, F.col("content")).alias("content"), F.when(over, "image exceeds the size limit").alias("problem"))

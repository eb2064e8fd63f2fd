"""JSON Lines and JSON arrays: readers that tell where a row is broken, and writers that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..session import drop_materialized, materialize


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON Lines file (.jsonl), blank lines skipped, or of a JSON file that holds one array."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    item = f"array<struct<{ddl}>>" if not ddl.startswith("struct<") else f"array<{ddl}>"
    checked = text.select(F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.lit("JSON input must contain a list"))).alias("value"))
    return checked.select(F.explode(F.from_json("value", item)).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of text files numbered from 1.

    A large file is read in blocks by many tasks: a line's number is its place in its block and the lines of the blocks
    before, which are counted in a pass of their own over the file. No task holds a file.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    counts = t.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    # ids grow along the lines of a task, which reads a block from its begin
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    numbered = t.withColumn("id", F.monotonically_increasing_id()).withColumn("place", place)
    return numbered.join(before, ["file", "block"]).select("file", (F.col("place") + F.col("before")).cast("bigint").alias("line_no"), "line")


def read_checked(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line_no, line, row, error) of each line that isn't blank: error tells broken JSON (anything behind the value, too) and rows that are no objects."""
    t = read_lines(spark, path).where(F.trim("line") != "")
    error = F.when(T.whole_json(F.col("line")).isNull(), "invalid JSON").when(~F.trim("line").startswith("{"), "each row must be an object")
    return t.withColumn("row", F.from_json("line", schema)).withColumn("error", error)


def first_error(checked: DataFrame) -> DataFrame:
    """(file, line_no, error): where a reader that fails fast would stop in each file."""
    return checked.where("error is not null").groupBy("file").agg(F.min(F.struct("line_no", "error")).alias("e")).select("file", "e.*")


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Writes rows as JSON Lines, texts unescaped; returns their number, counted while they are written."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def write_splits(rows: DataFrame, path: str, column: str = "split", rejected: Column | None = None) -> dict[str, int]:
    """Writes each split into a folder of its own in one pass; returns the rows of each, counted from what was written, and under rejected the rows that the condition leaves out. A null split is in the folder of unknown ones."""
    seen = Observation()
    watched = rows.observe(seen, F.count_if(F.coalesce(rejected, F.lit(False)) if rejected is not None else F.lit(False)).alias("n"))
    kept = watched.where(~F.coalesce(rejected, F.lit(False))) if rejected is not None else watched
    kept.write.mode("overwrite").partitionBy(column).json(path)
    back = rows.sparkSession.read.schema(f"`{column}` string").json(path)
    out = {r[column]: int(r["count"]) for r in back.groupBy(column).count().collect()}  # a row per split
    return out | ({"rejected": int(seen.get["n"])} if rejected is not None else {})


def write_audit(rows: DataFrame, path: str, trajectories: str = "trajectories") -> dict[str, int]:
    """Four outputs of audited rows (status, trajectories): all, the accepted, a row per accepted trajectory, and one per accepted row without trajectories. The rows are worked out once and kept in the shared folder until all four are written."""
    kept = materialize(rows, "audited")
    accepted = kept.where("status = 'accepted'")
    out = {
        "audit": write_jsonl(kept, f"{path}/audit"),
        "accepted": write_jsonl(accepted, f"{path}/accepted"),
        "sft": write_jsonl(accepted.withColumn("trajectory", F.explode(trajectories)).drop(trajectories), f"{path}/sft"),
        "rl": write_jsonl(accepted.drop(trajectories), f"{path}/rl"),
    }
    drop_materialized(rows.sparkSession, kept)
    return out

"""Session defaults and the few settings the operators read."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("loomtrail")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_loomtrail_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loomtrail-ship-"), "loomtrail.zip")  # on the driver alone, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("loomtrail", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._loomtrail_shipped = True


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine; local-cluster[...] isn't."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset and the master is local (tests). On a cluster an unset folder is an error: a machine's own folder would lose tables with the machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loomtrail-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that weighs more than a shuffle of its input. A table of many files or row groups stays as it is read; a small single file is dealt out."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a materialize()d table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomtrail import session


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).withColumn("x", F.rand())
    m = session.materialize(df, "cut")
    assert m.collect() == m.collect() and m.schema["x"].dataType == df.schema["x"].dataType
    files = m.inputFiles()
    assert files and all("/cut-" in f for f in files)
    session.drop_materialized(spark, m)
    assert not os.path.exists(files[0].removeprefix("file://"))


def test_empty_table_keeps_its_columns(spark):
    assert session.materialize(spark.range(0).select("id", F.lit("x").alias("y")), "empty").columns == ["id", "y"]


def test_spread_only_deals_out_few_partitions(spark):
    assert session.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(100, numPartitions=37)).rdd.getNumPartitions() == 37


def test_workers_get_the_package_without_a_path(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "from loomtrail.functions.records import scrub_json\n"
        "from loomtrail.session import ship\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "ship(s)\n"
        "print('GOT', s.range(1).select(scrub_json(F.lit('[1]'))).first()[0])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GOT [1]" in out.stdout, out.stderr[-2000:]


class _Cluster:
    """As much of a session as shared_dir() reads, on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return _Cluster.conf


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_dir(_Cluster)
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_a_broken_part_of_llm_is_an_error(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    if importlib.util.find_spec("loomtrail.llm") is None:
        assert e._llm() is None
        return
    monkeypatch.setattr(e.importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("no regex")))
    with pytest.raises(ModuleNotFoundError):
        e.queries()

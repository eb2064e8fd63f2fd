import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomtrail.session import local_session

    s = local_session(8, 8, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data_dir():
    return os.environ.get("LOOMTRAIL_DATA", "/root/testdata/sf0.001")

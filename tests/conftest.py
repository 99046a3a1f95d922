import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from tracewell.runtime import local_session

    s = local_session("tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    yield s
    s.stop()

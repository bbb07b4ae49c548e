import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import build_session
    s = build_session("local[4]", app="tidewatch-tests", shuffle_partitions=8,
                      conf={"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8",
                            "spark.default.parallelism": "4"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tidewatch-test-")

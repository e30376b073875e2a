import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskweave.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app_name="riskweave-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rw-test-ckpt-"),
                             "spark.sql.maxMetadataStringLength": "1000"})  # plans name files by their whole path
    yield s
    s.stop()

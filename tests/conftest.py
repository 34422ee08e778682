import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("COHORTKIT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cohortkit.session import get_spark
    s = get_spark("local[4]", app="cohortkit-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s

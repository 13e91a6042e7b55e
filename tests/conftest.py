import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("DATACLINIC_SCRATCH", tempfile.mkdtemp(prefix="dataclinic-test-"))
    from dataclinic.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SMALL

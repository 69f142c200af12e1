import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from revlens.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="revlens-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    """A fresh folder under the session's checkpoint folder."""
    from revlens.session import shared_path

    def make(name="t"):
        return shared_path(spark, name)

    return make

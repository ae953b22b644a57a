import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from webloom.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture
def page(spark):
    """A page table from HTML texts, one page each."""

    def make(*documents, url="https://www.example.com/dir/page.html?q=1#f"):
        return spark.createDataFrame([(i, url, h) for i, h in enumerate(documents)], "page_id BIGINT, url STRING, html STRING")

    return make

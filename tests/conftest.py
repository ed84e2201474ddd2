import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session
    s = local_session("*", 8, "tidemark-tests")
    yield s
    s.stop()


@pytest.fixture
def many_buckets(monkeypatch):
    """Force the bucketed (multi-task) path of the ordered operators on small data."""
    from tidemark.operators import align
    monkeypatch.setattr(align, "ROWS_PER_BUCKET", 7)
    yield


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)

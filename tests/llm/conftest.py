import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from compare import open_tables  # noqa: E402


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def small_sql(small_dir):
    return open_tables(small_dir)

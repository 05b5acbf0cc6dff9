import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm import frame  # noqa: E402


@pytest.fixture()
def edge(spark):
    return frame(spark)


@pytest.fixture()
def empty(spark):
    return frame(spark, [])

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from corpus_rows import ODD_ROWS, documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD_ROWS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])

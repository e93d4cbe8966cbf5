import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import helpers  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return helpers.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return helpers.empty(spark)

"""Oracle parity: Spark views against their DuckDB SQL on the sf0.001 fixture tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

from conftest import SF001  # noqa: E402

from settlekit.plans.views import VIEWS  # noqa: E402

NAMES = list(VIEWS)


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_view_matches_oracle(spark, con, name):
    line = compare.compare(spark, con, name, SF001)
    assert "EXACT" in line or "NEAR" in line, line

"""Spark queries beside their DuckDB SQL."""

import oracle
import pytest
from conftest import SF

from causalnet.queries import ORACLES, QUERIES

NAMES = [n for n in ORACLES if not n.endswith("_nml") and n not in ("contributor_scores", "skeleton_bic")] + ["mi_pair_nml"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert oracle.differ(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

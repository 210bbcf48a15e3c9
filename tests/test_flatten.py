"""Edges of variables from lagged edges."""

from causalnet.operators import temporal
from causalnet.queries import QUERIES
from conftest import SF


def test_self_loops_are_told_by_names_alone(spark):
    """The filter goes below the sums, to every joined row: there it may parse two names and no lags."""
    plan = QUERIES["flatten_drop"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "Join" in line or "Filter" in line]
    assert any("regexp" in line for line in below)
    assert all(line.count("regexp_") <= 2 and "RLIKE" not in line for line in below)


def test_drop_keeps_what_compact_has_between_variables(spark):
    names = ["a_lag0", "a_lag2", "b_lag0", "b_lag1", "c", "a", None]
    edges = spark.createDataFrame([(x, y, float(i * 10 + j)) for i, x in enumerate(names) for j, y in enumerate(names)], "x string, y string, info_shifted double")
    compact = temporal.flatten(edges)
    assert sorted(map(str, temporal.flatten(edges, "drop").collect())) == sorted(str(r) for r in compact.collect() if r["x"] is not None and r["y"] is not None and r["x"] != r["y"])

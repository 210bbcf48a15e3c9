"""Lagged edges of one pair of variables as one edge, by hand."""

from causalnet.operators.temporal import combined

SCHEMA = "x string, y string, ort_inferred int, p_y2x double, p_x2y double, info_shifted double"


def found(spark, rows):
    return {(r["x"], r["y"]): tuple(r)[2:] for r in combined(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_one_edge_goes_from_old_to_new(spark):
    got = found(spark, [("a_lag0", "b_lag2", -2, 0.9, 0.2, 5.0), ("c_lag1", "c_lag0", 2, 0.1, 1.0, 3.0), ("d_lag0", "e_lag0", 1, None, None, 1.0)])
    assert got == {("b", "a"): ("2", 2, 0.2, 0.9, 5.0), ("c", "c"): ("1", 2, 0.1, 1.0, 3.0), ("d", "e"): ("0", 1, None, None, 1.0)}


def test_directions_lags_and_probabilities(spark):
    rows = [("a_lag3", "b_lag0", 2, 0.3, 0.8, 5.0), ("a_lag1", "b_lag0", 2, 0.1, 0.7, 9.0), ("a_lag0", "b_lag0", 1, 0.5, 0.5, 2.0)]
    assert found(spark, rows)["a", "b"] == ("3,1,0", 2, 0.1, 0.8, 9.0)
    back = rows + [("b_lag2", "a_lag0", 2, 0.2, 0.9, 4.0)]  # from b to a: a head at a
    assert found(spark, back)["a", "b"] == ("3,1/0/2", 6, 0.9, 0.8, 9.0)
    against = [("a_lag1", "b_lag0", -2, 0.7, 0.2, 1.0), ("a_lag0", "b_lag0", -2, 0.6, 0.4, 2.0)]  # the newer one would be the cause
    assert found(spark, against)["a", "b"] == ("0,-1", -2, 0.7, 0.2, 2.0)
    both = [("a_lag1", "b_lag0", 6, 0.7, 0.8, 1.0), ("a_lag2", "b_lag0", 1, 0.4, 0.4, 2.0)]
    assert found(spark, both)["a", "b"] == ("2,1/-1", 6, 0.7, 0.8, 2.0)
    none = [("a_lag1", "b_lag0", 1, 0.2, 0.4, 1.0), ("a_lag2", "b_lag0", 1, 0.4, 0.2, 2.0)]
    assert found(spark, none)["a", "b"][1:] == (1, 0.30000000000000004, 0.30000000000000004, 2.0)

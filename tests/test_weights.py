import warnings

import numpy as np
import pandas as pd
import pytest

from causalnet.operators import standalone
from causalnet.operators.network import reconstruct
from causalnet.operators.timeseries import known_pairs, lagged_variables, reconstruct_series
from causalnet.sources.observations import Options


def table(spark, n=600):
    g = np.random.default_rng(3)
    a = g.integers(0, 3, n)
    b = np.where(g.random(n) < 0.8, a, g.integers(0, 3, n))
    c = np.where(g.random(n) < 0.8, b, g.integers(0, 3, n))
    twice = g.integers(0, 2, n)
    return pd.DataFrame({"a": a.astype(str), "b": b.astype(str), "c": c.astype(str), "w": twice.astype(float), "half": 0.5, "bad": 1.5})


def kept(r):
    return {(q["x"], q["y"]): (round(q["info"], 6), round(q["info_shifted"], 6), round(q["n"], 6)) for q in r.edges.collect()}


def test_weights_of_nought_and_one_choose_rows(spark):
    p = table(spark)
    some = reconstruct(spark.createDataFrame(p[["a", "b", "c", "w"]]), latent="no", sample_weights="w", cplx="bic")
    alone = reconstruct(spark.createDataFrame(p[p.w == 1][["a", "b", "c"]]), latent="no", cplx="bic")
    assert kept(some) == kept(alone)


def test_equal_weights_are_an_effective_size(spark):
    p = table(spark)
    half = reconstruct(spark.createDataFrame(p[["a", "b", "c", "half"]]), latent="no", sample_weights="half")
    size = reconstruct(spark.createDataFrame(p[["a", "b", "c"]]), latent="no", n_eff=300)
    assert kept(half) == kept(size)
    one = standalone.mutual_information(spark.createDataFrame(p), "a", "b", sample_weights="half").collect()[0]
    two = standalone.mutual_information(spark.createDataFrame(p), "a", "b", n_eff=300).collect()[0]
    assert one["n"] == pytest.approx(300) and one["infok"] == pytest.approx(two["infok"])


def test_weights_beyond_one_are_ignored(spark):
    p = table(spark)
    with pytest.warns(UserWarning, match="ignored"):
        r = reconstruct(spark.createDataFrame(p[["a", "b", "c", "bad"]]), latent="no", sample_weights="bad")
    assert kept(r) == kept(reconstruct(spark.createDataFrame(p[["a", "b", "c"]]), latent="no"))
    with pytest.raises(ValueError):
        reconstruct(spark.createDataFrame(p[["a", "b"]]), sample_weights="none")
    for wrong in ({"n_eff": 0}, {"max_iteration": 0}, {"ort_consensus_ratio": 2.0}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_summary_beside_the_truth(spark):
    p = table(spark)[["a", "b", "c"]]
    p["z"] = np.random.default_rng(5).integers(0, 2, len(p)).astype(str)
    truth = spark.createDataFrame([("b", "a"), ("z", "a")], "x string, y string")
    got = {(q["x"], q["y"]): q for q in reconstruct(spark.createDataFrame(p), latent="no", true_edges=truth).summary.collect()}
    assert got["a", "b"]["type"] == "TP" and got["a", "b"]["ort_ground_truth"] == -2
    assert got["a", "b"]["is_inference_correct"] == (got["a", "b"]["ort_inferred"] == -2)
    assert got["b", "c"]["type"] == "FP" and got["b", "c"]["ort_ground_truth"] == 0
    assert got["a", "z"]["type"] == "FN" and got["a", "z"]["ort_ground_truth"] == -2 and not got["a", "z"]["is_inference_correct"]
    assert got["a", "b"]["ort_consensus"] is None and got["a", "b"]["edge_stats"] is None


def series(spark):
    g = np.random.default_rng(1)
    rows = []
    for k in range(6):
        a = g.integers(0, 3, 120)
        b = np.where(g.random(120) < 0.9, np.roll(a, 1), g.integers(0, 3, 120))
        rows += [(k, t, str(a[t]), str(b[t])) for t in range(120)]
    return spark.createDataFrame(rows, "k int, t int, a string, b string")


def test_lists_of_a_series_are_lagged(spark):
    s = series(spark)
    free = kept_names(reconstruct_series(s, ["k"], "t", ["a", "b"], n_layers=2, delta_t=1, latent="no"))
    assert ("a_lag1", "b_lag0") in free
    truth = spark.createDataFrame([("a", "b", 1)], "x string, y string, lag int")
    with pytest.warns(UserWarning, match="a_lag7"):
        r = reconstruct_series(s, ["k"], "t", ["a", "b"], n_layers=2, delta_t=1, latent="no", black_box=[("a", "b", 1), ("a", "b", 7)], true_edges=truth)
    assert ("a_lag1", "b_lag0") not in kept_names(r) and r.scores.collect()[0]["fn"] == 1
    with pytest.raises(ValueError):
        reconstruct_series(s, ["k"], "t", ["a", "b"], n_layers=2, delta_t=1, black_box=[("a", "b")])


def kept_names(r):
    return {(q["x"], q["y"]) for q in r.edges.where("connected").collect()}


def test_types_are_checked_after_lagging(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(8)], "t int, v double")
    lagged = spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.0, None), (3.0, 1.0, None), (4.0, 1.0, None), (5.0, 1.0, None)], "v_lag0 double, v_lag1 double, v_lag2 double")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = lagged_variables(df, lagged, ["v"])
        assert known_pairs(spark.createDataFrame([("v_lag0", "v_lag1"), ("v_lag0", "u_lag1")], "var1 string, var2 string"), ["v_lag0", "v_lag1"], "list").count() == 1
    assert [v.continuous for v in found] == [True, False, False]
    assert any("v_lag1" in str(w.message) for w in said) and any("v_lag2" in str(w.message) for w in said) and any("u_lag1" in str(w.message) for w in said)

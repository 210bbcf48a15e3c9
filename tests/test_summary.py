"""Columns of the summary that hang on gaps, against plain counts."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalnet.functions.kernel import Sample
from causalnet.operators import discrete
from causalnet.operators.network import reconstruct
from causalnet.queries import QUERIES


def test_contributors_with_gaps(spark):
    """x and y are joined by u and v alone; u is unknown in some rows, v in others, at random."""
    g = np.random.default_rng(11)
    n = 20_000
    u, v = g.integers(0, 3, n), g.integers(0, 3, n)
    seen = lambda k: np.where(g.random(n) < 0.65, k, g.integers(0, 3, n))
    x, y = 3 * seen(u) + seen(v), 3 * seen(u) + seen(v)
    p = pd.DataFrame({c: k.astype(str) for c, k in dict(x=x, y=y, u=u, v=v).items()})
    p.loc[g.random(n) < 0.3, "u"] = None
    p.loc[g.random(n) < 0.2, "v"] = None
    r = reconstruct(spark.createDataFrame(p), latent="no", cplx="bic", orientation=False, test_mar=False)
    row = next(q for q in r.summary.collect() if (q["x"], q["y"]) == ("x", "y"))
    assert set(row["ai"].split(",")) == {"u", "v"} and row["type"] == "N"
    both = p.dropna()
    assert row["n_xy"] == n and row["n_xy_ai"] == len(both) < n
    first, second = row["ai"].split(",")

    def sample(rows, *names):
        return Sample([rows[c].astype("category").cat.codes.to_numpy() for c in names], [False] * len(names), cplx="bic")

    pair = sample(p, "x", "y").mutual()
    assert row["info"] == pytest.approx(pair.info)
    one = sample(p.dropna(subset=[first]), "x", "y", first).three_point(0, 1, 2)
    two = sample(both, "x", "y", second, first).three_point(0, 1, 2, [3])
    raw = [(t["i3"] - t["k3"]) / pair.shifted for t in (one, two)]
    left = [(t["i3"] - t["k3"]) / (t["i2"] - t["k2"]) for t in (one, two)]
    got = [[float(c) for c in row[name].split(",")] for name in ("raw_contributions", "contributions")]
    assert got[0] == pytest.approx(raw, abs=1e-5) and got[1] == pytest.approx(left, abs=1e-5)
    assert abs(got[0][1] - got[1][1]) > 0.05
    edge = next(q for q in r.edges.collect() if (q["x"], q["y"]) == ("x", "y"))
    assert edge["n"] == n and edge["n_cond"] == len(both) and edge["raw_contributions"] == pytest.approx(raw, abs=1e-9)


def test_a_mediator_is_found(spark):
    rows = QUERIES["best_contributor"](spark, "/root/testdata/sf0.001").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [("fine", "coarse", "middle")] and rows[0]["score"] > 0


def test_a_best_contributor_outlives_the_order_of_sums(spark):
    """On executors the last bits of a score follow the order in which partial sums arrive, so no two evaluations need agree."""
    late = F.udf(lambda s: s * (1 + int.from_bytes(os.urandom(4), "big") * 2.0**-50), "double").asNondeterministic()
    rows = [("a", "b", "p", 1.0), ("a", "b", "q", 3.0), ("a", "b", "r", 2.0), ("c", "d", "p", 0.5), ("c", "d", "q", -1.0), ("e", "f", "p", -2.0), ("e", "f", "q", 0.0)]
    scores = spark.createDataFrame(rows, "x string, y string, z string, score double").withColumn("score", late("score"))
    best = discrete.best_contributor(scores).collect()
    assert sorted((r["x"], r["y"], r["z"], round(r["score"], 3)) for r in best) == [("a", "b", "q", 3.0), ("c", "d", "p", 0.5)]


def test_equal_scores_go_to_the_first_name(spark):
    rows = [("a", "b", "r", 2.0), ("a", "b", "q", 2.0), ("a", "b", "p", 1.0)]
    best = discrete.best_contributor(spark.createDataFrame(rows, "x string, y string, z string, score double")).collect()
    assert [(r["x"], r["y"], r["z"], r["score"]) for r in best] == [("a", "b", "q", 2.0)]

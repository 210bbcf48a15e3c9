import numpy as np
import pandas as pd

from causalnet.operators import graph
from causalnet.operators.network import reconstruct
from causalnet.sources import observations, sinks
from causalnet.streaming.counts import streaming_cells


def simulated(spark, n=1500):
    g = np.random.default_rng(0)
    a = g.integers(0, 3, n)
    b = np.where(g.random(n) < 0.85, a, g.integers(0, 3, n))
    c = np.where(g.random(n) < 0.85, b, g.integers(0, 3, n))
    x, y = g.integers(0, 2, n), g.integers(0, 2, n)
    z = np.where(g.random(n) < 0.95, x | y, 1 - (x | y))
    return spark.createDataFrame(pd.DataFrame({k: v.astype(str) for k, v in dict(a=a, b=b, c=c, x=x, y=y, z=z).items()}))


def test_reconstruct(spark):
    truth = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "z"), ("y", "z")], "x string, y string")
    r = reconstruct(simulated(spark), latent="no", true_edges=truth)
    e = {(q["x"], q["y"]): q for q in r.edges.collect()}
    assert {p for p, q in e.items() if q["connected"]} == {("a", "b"), ("b", "c"), ("x", "z"), ("y", "z")}
    assert e[("a", "c")]["ai"] == ["b"]
    assert e[("x", "z")]["ort_inferred"] == 2 and e[("y", "z")]["ort_inferred"] == 2
    assert r.scores.collect()[0]["fscore"] == 1.0
    assert {q["type"] for q in r.summary.collect()} <= {"TP", "TN"}


def test_blocks_and_paths():
    near = graph.neighbours([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)])
    assert {frozenset(b) for b in graph.blocks(near)} == {frozenset({0, 1, 2}), frozenset({2, 3}), frozenset({3, 4, 5})}
    assert graph.on_paths(near, 0, 1) == {2}
    assert graph.on_paths(near, 0, 4) == {1, 2, 3, 5}
    t = graph.CycleTracker()
    assert t.add([1]) is None and t.add([2]) is None and len(t.add([1])) == 2


def test_checks(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "u"), (None, None, None)], "a int, b string, c string")
    assert observations.check_observations(df).columns == ["a", "c"] and observations.check_observations(df).count() == 2
    p = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a"), ("a", "zz")], "var1 string, var2 string")
    assert observations.canonical_pairs(p, ["a", "c"]).collect() == [("a", "c")]


def test_sinks(spark):
    s = spark.createDataFrame([("a", "b", -2, 5.0, 0.5), ("b", "c", 6, 30.0, -1.0)], "x string, y string, ort_inferred int, info_shifted double, partial_correlation double")
    e = {r["label"]: r for r in sinks.export_edges(s).collect()}
    assert e["b-->a"]["weight"] == 2.0 and e["b<->c"]["weight"] == 8.0 and e["b<->c"]["colour_step"] == 0
    assert sum("<edge" in x for x in sinks.graphml_lines(s, ["a", "b", "c"])) == 2
    assert len(sinks.xgmml_lines(s, {"a": (1, 2)})) == 6 and sinks.style_lines()
    assert sinks.grid_layout(["a_lag1", "a_lag0"])["a_lag1"] == (0.0, 0.0)


def test_streaming_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("a", "x")], "u string, v string")
    df.write.parquet(str(tmp_path / "in"))
    q = streaming_cells(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), [("u", "v")]).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["v0"], r["v1"], r["n"]) for r in spark.table("cells").collect()} == {("a", "x", 2.0), ("a", "y", 1.0)}


def test_edges_that_change_in_a_cycle_stand_undirected(spark):
    """Two graphs take turns: an edge turns round in one of them, another comes and goes."""
    from causalnet.operators.network import Edge, Reconstruction
    from causalnet.sources.observations import Options, Variable

    class Turns(Reconstruction):
        step = 0

        def unconditional(self):
            pass

        def skeleton(self, allowed=None):
            self.edges = {(0, 1): Edge(0, 1), (0, 2): Edge(0, 2), (1, 2): Edge(1, 2, connected=self.step % 2 == 0)}

        def confidence(self):
            pass

        def orient(self):
            turn = self.step % 2
            for e in self.edges.values():
                e.p, e.tip = {e.x: 0.9, e.y: 0.2}, {e.x: 2, e.y: 1}
            if turn:
                e = self.edges[0, 1]
                e.p, e.tip = {0: 0.2, 1: 0.9}, {0: 1, 1: 2}
            self.step += 1

    class Answers:
        variables = [Variable(c) for c in "abc"]

    r = Turns(Answers(), Options(consistent="orientation")).run()
    assert r.step == 3 and len(r.history) == 2
    assert [r.code(r.edges[p]) for p in ((0, 1), (0, 2), (1, 2))] == [1, -2, 1]


def test_metadata_of_lags_are_checked(spark):
    import pytest

    df = spark.createDataFrame([("u", 1), ("v", 2)], "a string, b int")
    good = observations.variables(df, [{"var_names": "a", "n_layers": 3, "delta_t": 0, "mov_avg": 2.0}])[0]
    assert (good.n_layers, good.delta_t, good.mov_avg) == (3, 0, 2)
    for name, wrong in (("n_layers", 0), ("n_layers", 1.5), ("delta_t", -1), ("delta_t", "x"), ("mov_avg", 1), ("mov_avg", float("inf"))):
        with pytest.warns(UserWarning, match=f"{name} of a is incorrect"):
            assert getattr(observations.variables(df, [{"var_names": "a", name: wrong}])[0], name) is None
    assert observations.variables(df, [{"var_names": "a", "n_layers": float("nan")}])[0].n_layers is None


def test_levels_are_compared_with_an_order(spark):
    import warnings

    df = spark.createDataFrame([("u",), ("w",), (None,)], "a string")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert observations.check_levels(df, observations.Variable("a", levels=("u", "v"))) == (["v"], ["w"])
    assert any("outside the given order: w" in str(w.message) for w in said)

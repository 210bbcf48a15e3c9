"""Equal rows are counted once; all that follows from them is the same as from the rows themselves."""

import numpy as np
import pandas as pd
import pytest

from causalnet.operators import network
from causalnet.operators.network import permutation_means, permuted
from causalnet.plans.requests import Engine
from causalnet.sources.observations import Options, Variable


def observations(n: int = 3000) -> pd.DataFrame:
    r = np.random.default_rng(12)
    a = r.integers(0, 4, n)
    p = pd.DataFrame({"a": a, "b": np.where(r.random(n) < 0.6, a, r.integers(0, 4, n)), "c": r.integers(0, 3, n)}).astype(str)
    return p.mask(pd.DataFrame(r.random(p.shape) < [0.05, 0, 0.1], columns=p.columns)).replace({np.nan: None})


def test_engine_holds_different_rows_once(spark):
    p = observations()
    e = Engine(spark.createDataFrame(p, "a string, b string, c string"), [Variable(c) for c in "abc"])
    assert e.n == len(p) and e.rows.count() == e.held == len(p.drop_duplicates()) < 100 and e.gaps == {"v0", "v2"}
    e.run([e.two(0, 1), e.three(0, 1, 2)])
    whole = p[["a", "b"]].dropna()
    f = pd.crosstab(whole.a, whole.b).to_numpy() / len(whole)
    want = len(whole) * np.nansum(f * np.log(np.where(f > 0, f, np.nan) / f.sum(1, keepdims=True) / f.sum(0)))
    assert e.get(e.two(0, 1))["n"] == len(whole) and e.get(e.two(0, 1))["info"] == pytest.approx(want)
    e.close()


@pytest.mark.parametrize("step", [10, 700, 1 << 19])
def test_shuffles_need_no_join_where_different_rows_are_few(spark, monkeypatch, step):
    p = observations()
    e = Engine(spark.createDataFrame(p, "a string, b string, c string"), [Variable(c) for c in "abc"])
    seen, moved = [], e.moved
    monkeypatch.setattr(e, "moved", lambda *a: seen.append(moved(*a)) or seen[-1])
    pairs = [(0, 1), (0, 2), (1, 2)]
    joined = permutation_means(e, pairs, 2, few=0)
    monkeypatch.setattr(network, "spread", None)  # the join's rows are not made
    assert permutation_means(e, pairs, 2, step=step) == pytest.approx(joined)
    values = [[found[k] for k in range(3)] for found in seen]
    assert np.allclose(values[:2], values[2:], rtol=0, atol=1e-9) and len(np.unique(np.round(values[:2], 6))) == 6
    e.close()


def test_moved_rows_are_the_bijection(spark):
    p = observations(1000)
    e = Engine(spark.createDataFrame(p, "a string, b string, c string"), [Variable(c) for c in "abc"])
    rows, groups = network.numbered(e.rows)
    plain = rows.toPandas().sort_values("at_").reset_index(drop=True)
    assert plain["at_"].tolist() == list(range(1000))
    groups.unpersist()
    first, groups, _ = network.ordered(e.rows)
    table = first.toArrow().sort_by("first_")
    found = pd.concat(b.to_pandas() for b in network._matched(table, [0], [1], 1000, 43)(iter(spark.range(1).toArrow().to_batches())))
    groups.unpersist()
    moved = plain.assign(x0=plain.set_index(permuted(np.arange(1000), 1000, 43))["v0"].sort_index())
    want = moved.groupby(["x0", "v1"], dropna=False).size()
    got = found.groupby(["x0", "v1"], dropna=False)["n_"].sum()
    assert sorted(want.tolist()) == sorted(got.tolist()) and got.sum() == 1000
    e.close()


def test_network_reads_discrete_observations_once(spark):
    """Checks, metadata and counts all come from the first reading."""
    p = observations(1000)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(p, "a string, b string, c string").mapInPandas(seen, "a string, b string, c string")
    network.reconstruct(df).edges.collect()
    assert read.value == len(p)


def test_network_of_equal_rows_is_that_of_the_rows(spark, monkeypatch):
    p = observations(1500).assign(k=lambda t: t.c.fillna("9").astype(int), n_="x")
    p["m"] = p.k // 2 + np.random.default_rng(3).integers(0, 2, len(p))
    p.loc[:20, ["a", "b", "c"]] = None
    df = spark.createDataFrame(p, "a string, b string, c string, k int, n_ string, m int")
    numbers = [Variable("k", False), Variable("m", False)]
    once = network.reconstruct(df, numbers)
    monkeypatch.setattr(network, "surely_discrete", lambda *a: False)
    each = network.reconstruct(df, numbers)
    assert once.summary.where("partial_correlation > 0").count()
    assert once.variables == each.variables
    for name in ("edges", "summary", "triples"):
        a, b = getattr(once, name).toPandas(), getattr(each, name).toPandas()
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)

"""Exact places from sums over ranges, and searches in rounds beside those in one task."""

import numpy as np
import pandas as pd
import pytest

from causalnet.functions.kernel import Sample, dense, equal_frequency_bins, groups_of
from causalnet.operators.network import numbered, permuted
from causalnet.operators.standalone import discretise_mutual, mutual_information
from causalnet.plans import rounds, scales
from causalnet.plans.requests import Engine
from causalnet.plans.rounds import Request, Setting
from causalnet.sources.observations import Options, Variable


def columns(seed, n):
    r = np.random.default_rng(seed)
    return {"v0": r.normal(size=n).round(2), "v1": np.where(r.random(n) < 0.4, 7.0, r.integers(0, 40, n)), "v2": r.permutation(n).astype(float), "v3": np.full(n, 2.0), "v4": r.integers(0, 2, n).astype(float)}


@pytest.mark.parametrize("span", [60, 1 << 20])
def test_places_are_where_a_search_may_cut(spark, span):
    n = 1500
    p = pd.DataFrame(columns(3, n))
    gap = np.random.default_rng(4).random(n) < 0.3
    p["g"] = np.where(gap, np.nan, 1.0)
    rows = spark.createDataFrame(p).select(*p.columns[:-1], "g").replace(float("nan"), None, ["g"])
    wanted = [(c, ()) for c in p.columns[:-1]] + [("v0", ("g",)), ("v2", ("g",))]
    got = scales.places(scales.tally(rows, wanted), len(wanted), 50, span)
    for (c, others), places in zip(wanted, got):
        v = p[c].to_numpy()[~gap] if others else p[c].to_numpy()
        values, at, count = np.unique(v, return_inverse=True, return_counts=True)
        assert (places.levels, places.rows) == (len(values), len(v))
        s, place = places.scale(), places.of(values)
        if len(values) < 3:
            assert not s.continuous and place.tolist() == list(range(len(values)))
            continue
        assert s.group[place].tolist() == groups_of(len(values), 50).tolist()
        for bins in range(2, 31):
            assert s.equal(bins)[place].tolist() == equal_frequency_bins(count, bins).tolist(), (c, bins)
        assert len(places.first) <= min(len(values), 500)
        cut = np.flatnonzero(np.diff(place))[:3]
        assert [places.middle(k) for k in range(len(cut))] == [(values[i] + values[i + 1]) / 2 for i in cut]


def table(n=1200, seed=1):
    r = np.random.default_rng(seed)
    z = r.normal(size=n)
    p = pd.DataFrame({"x": z + 0.6 * r.normal(size=n), "y": (z + 0.8 * r.normal(size=n)).round(1), "z": z, "c": r.choice(list("abc"), n), "w": r.random(n)})
    p["d"] = np.where(p.x > 0, p.c, "a")
    return p


def held_by_one(p, names, kinds, kind, w=None, initbins=10):
    codes = [dense(p[c].to_numpy()) if k else p[c].astype("category").cat.codes.to_numpy() for c, k in zip(names, kinds)]
    s = Sample(codes, kinds, w, "nml", 50, initbins, len(p), np.ones(len(p)))
    return rounds.plain(s.run(rounds.begin(s.search, kind, len(names), Setting())))


REQUESTS = [("2", "xy"), ("2", "xc"), ("2", "cd"), ("2", "xyz"), ("2", "xyc"), ("2", "cdx"), ("2", "cdxy"), ("3", "xyz"), ("3", "cdx"), ("3", "xycz"), ("tie", "xyz")]


@pytest.mark.parametrize("weighted", [False, True])
def test_rounds_equal_one_task(spark, weighted):
    p = table()
    numbers = {c: c in "xyz" for c in "xyzcd"}
    kinds = {f"v{i}": k for i, k in enumerate(numbers.values())}
    rows = rounds.observed(spark.createDataFrame(p), list(numbers.items()), "w" if weighted else None).persist()
    name = dict(zip(numbers, kinds))
    asked = [Request(k, tuple(name[c] for c in cs)) for k, cs in REQUESTS]
    o = Setting(initbins=10)
    wanted = [(c, ()) for c, k in kinds.items() if k]
    o.scales = dict(zip(wanted, scales.places(scales.tally(rows, wanted), len(wanted), 50)))
    one = rounds.solve(rows, asked, kinds, set(), o, weighted)
    many = rounds.solve(rows, asked, kinds, set(), o, weighted, held=0)
    rows.unpersist()
    for k, (kind, cs) in enumerate(REQUESTS):
        want = held_by_one(p, cs, [numbers[c] for c in cs], kind, p.w.to_numpy() if weighted else None)
        for got in (one[k], many[k]):
            assert {c: v for c, v in got.items() if c != "cuts"} == pytest.approx({c: v for c, v in want.items() if c != "cuts"}, rel=1e-6, abs=1e-6), (kind, cs)
        assert len(one[k].get("cuts", [])) == len(want.get("cuts", []))


def test_gaps_decide_which_values_count(spark):
    p = table(900, 2)
    r = np.random.default_rng(8)
    p.loc[r.random(len(p)) < 0.2, "z"] = np.nan
    p.loc[r.random(len(p)) < 0.1, "c"] = None
    df = spark.createDataFrame(p[list("xyzc")]).replace(float("nan"), None)
    e = Engine(df, [Variable(c, c != "c") for c in "xyzc"], Options(test_mar=False))
    asks = [e.two(0, 1), e.two(0, 2), e.two(0, 1, [2]), e.two(0, 1, [2, 3]), e.three(0, 1, 2), e.tie(0, 1, 2)]
    e.run(asks)
    start = min(30, int(0.5 + len(p) ** (1 / 3)))
    for q, (kind, cs) in zip(asks, [("2", "xy"), ("2", "xz"), ("2", "xyz"), ("2", "xyzc"), ("3", "xyz"), ("tie", "xyz")]):
        known = p.dropna(subset=list(cs))
        want = held_by_one(known, cs, [c != "c" for c in cs], kind, initbins=start)
        got = e.get(q)
        for c in got:
            assert got[c] == pytest.approx(want[c], rel=1e-6, abs=1e-6), (q, c)
    e.close()


def test_many_requests_have_one_short_plan(spark):
    p = pd.DataFrame(np.random.default_rng(1).integers(0, 3, (200, 50)).astype(str), columns=[f"a{i}" for i in range(50)])
    kinds = {f"v{i}": False for i in range(50)}
    rows = rounds.observed(spark.createDataFrame(p), [(c, False) for c in p])
    asked = [Request("2", (f"v{i}", f"v{j}")) for i in range(50) for j in range(i + 1, 50)]
    size = lambda k: len(rounds.cells(rows, asked[:k], {}, set(), False).groupBy("k").count()._jdf.queryExecution().optimizedPlan().toString())
    assert size(len(asked)) < size(300) + 3000
    found = rounds.solve(rows, asked, kinds, set(), Setting(), False, n_rows=200)
    assert len(found) == len(asked) == 1225 and found[7]["info"] == pytest.approx(held_by_one(p, ["a0", "a8"], [False, False], "2")["info"])


def test_answers_of_many_values_are_exact(spark):
    r = np.random.default_rng(5)
    n = 30_000
    x = r.permutation(n) + 0.25
    y = (x > 0.7 * n) * 3.0 + r.random(n)
    got = mutual_information(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").collect()[0]
    start = min(30, round(n ** (1 / 3)))
    want = Sample([dense(x), dense(y)], [True, True], None, "nml", 50, start, n).mutual()
    assert got["info"] == pytest.approx(want.info) and got["infok"] == pytest.approx(want.shifted) and got["n_iterations"] == len(want.cuts)


def test_ends_of_the_cuts(spark):
    p = table(400, 3)
    got = discretise_mutual(spark.createDataFrame(p), "x", "c").toPandas()
    low = min(p.x.std(), p.c.map({"a": 0, "b": 1, "c": 2}).std()) / 100
    for _, g in got.groupby("iteration"):
        assert set(g.variable) == {"x"} and g.cut.iloc[0] == pytest.approx(p.x.min() - low) and g.cut.iloc[-1] == p.x.max()
    inner = discretise_mutual(spark.createDataFrame(p), "x", "c", ends=False)
    assert inner.count() == len(got) - 2 * got.iteration.nunique()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_shuffles_are_bijections(n):
    seen = [permuted(np.arange(n), n, key) for key in range(4)]
    assert all(sorted(s.tolist()) == list(range(n)) for s in seen)
    if n > 60:
        assert len({tuple(s.tolist()) for s in seen}) == 4 and abs(np.corrcoef(np.arange(n), seen[0])[0, 1]) < 0.3
        assert permuted(np.arange(n)[::-1], n, 2).tolist() == seen[2][::-1].tolist()


def test_row_numbers_follow_from_the_values(spark):
    r = np.random.default_rng(6)
    p = pd.DataFrame({"a": r.integers(0, 5, 9000), "b": np.where(r.random(9000) < 0.7, 1, r.integers(0, 400, 9000))})
    one = numbered(spark.createDataFrame(p))[0].toPandas().sort_values("at_")
    two = numbered(spark.createDataFrame(p.sample(frac=1, random_state=1)).repartition(7), span=100)[0].toPandas().sort_values("at_")
    assert one.at_.tolist() == list(range(9000)) and (one.to_numpy() == two.to_numpy()).all()
    assert sorted(map(tuple, one[["a", "b"]].to_numpy())) == sorted(map(tuple, p.to_numpy()))

"""Relaxation times by blocks of lags, and windows that leave enough rows, against plain counting."""

import numpy as np
import pandas as pd
import pytest

from causalnet.operators import temporal
from causalnet.operators.temporal import autocorrelation_until, check_trajectories, estimate_dynamic, longest_window, samples_after, shrink_window, trajectory_lengths


def acf(v, lags):
    d = v - v.mean()
    return [float((d[k:] * d[: len(d) - k]).sum() / (d * d).sum()) for k in range(lags)]


def alpha(v, lags):
    a = acf(v, lags)
    gone = next((k for k in range(1, lags) if a[k] < 0.05), lags - 1)
    at = max(1, round(gone / 2))
    return np.nan if a[at] < 0 and at > 1 else np.sign(a[at]) * abs(a[at]) ** (1 / at)


def test_lags_go_to_the_shortest_trajectory(spark):
    sizes = {0: 1, 1: 140, 2: 200}
    wave = lambda n: np.sin(2 * np.pi * np.arange(n) / 280) + 0.01 * np.arange(n)
    rows = [(k, i, float(v)) for k, n in sizes.items() for i, v in enumerate(wave(n))]
    mean = np.nanmean([alpha(wave(n), 140) for n in (140, 200)])
    tau = round((1 + mean) / (1 - mean))
    want = max(1, min(140, tau, 2 * tau))
    got = estimate_dynamic(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], "t", ["v"], shrink=False).collect()[0]
    assert got["tau"] == want


@pytest.mark.parametrize("block, chunk", [(4, 16), (32, 8192)])
def test_autocorrelation_of_blocks(spark, block, chunk):
    r = np.random.default_rng(block)
    series = {0: np.cumsum(r.normal(size=150)), 1: r.normal(size=90), 2: np.sin(np.arange(200) / 30), 3: np.full(40, 2.0), 4: np.array([1.0]), 5: np.array([1.0, 3.0, 2.0])}
    rows = [(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(3)
    got, held = autocorrelation_until(df, ["k"], "t", "v", 120, block=block, chunk=chunk)
    found = got.toPandas()
    for t in held:
        t.unpersist()
    assert set(found.k) == {0, 1, 2, 5}
    for k, s in series.items():
        mine = found[found.k == k].sort_values("lag")
        if not len(mine):
            continue
        want = acf(s, min(121, len(s)))
        assert mine.lag.tolist() == list(range(1, len(mine) + 1)) and mine.acf.tolist() == pytest.approx(want[1 : len(mine) + 1], abs=1e-9)
        under = [j for j in range(1, len(want)) if want[j] < 0.05]
        assert len(mine) >= (under[0] if under else len(want) - 1)
    if block == 4:  # white noise has vanished in the first block and is not looked at again
        assert (found.k == 1).sum() <= 12 and (found.k == 2).sum() > 40


def test_long_trajectories_have_a_short_plan(spark):
    r = np.random.default_rng(1)
    n = 30_000
    v = np.zeros(n)
    for i in range(1, n):
        v[i] = 0.97 * v[i - 1] + r.normal()
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(n), "v": v}))
    got = temporal.relaxation_times(df, ["k"], "t", ["v"], n - 1)
    a = alpha(v, 2000)
    assert got == {"v": round((1 + a) / (1 - a))}


def lengths_of(spark, sizes):
    return spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k int, t int")


@pytest.mark.parametrize("seed", range(6))
def test_windows_against_plain_counting(spark, seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 60, int(r.integers(1, 30))).tolist()
    lengths = trajectory_lengths(lengths_of(spark, sizes), ["k"]).persist()
    left = lambda lag: sum(max(0, n - lag) for n in sizes)
    for most in (2, 10, 70):
        target = min(1000, sum(sizes) / 10) * float(r.choice([0.5, 1, 4]))
        want = max([lag for lag in range(1, most) if left(lag) >= target], default=1)
        assert longest_window(lengths, target, most) == want
    assert samples_after(lengths, 7) == left(7)
    lengths.unpersist()


def test_odd_time_steps_are_told(spark):
    rows = [("a", i, t) for i, t in enumerate([1, 2, 2, 3, 6, 1, 2, 4])] + [("b", 0, 2), ("b", 1, 3)]
    df = spark.createDataFrame(rows, "k string, i int, t int")
    with pytest.warns(UserWarning) as said:
        assert check_trajectories(df, "i", "t", ["k"]) == {"unchanged": 1, "gaps": 2, "starts": 1}
    told = [str(w.message) for w in said if w.category is UserWarning]
    assert [t for t in told if "step" in t] == ["time step unchanged at 1 positions", "gap in the time steps at 2 positions", "1 trajectories don't start with 1 as first time step"], told
    for wrong, kind in (([("a", 0, None)], "int"), ([("a", 0, 1.5)], "double"), ([("a", 0, "x")], "string"), ([("a", 0, 1), ("b", 0, 1)], "int")):
        with pytest.raises(ValueError):
            check_trajectories(spark.createDataFrame(wrong, f"k string, i int, t {kind}"), "i", "t", ["k"])


def test_windows_shrink(spark):
    lengths = trajectory_lengths(lengths_of(spark, [30] * 20 + [12] * 10), ["k"])  # 720 rows, 72 are wanted
    assert shrink_window(lengths, [3], [5], "delta_t") == ([3], [5])
    assert shrink_window(lengths, [6], [6], "delta_t") == ([6], [5])  # 26 steps back leave 80 rows
    assert shrink_window(lengths, [20, 2], [2, 1], "n_layers") == ([14, 2], [2, 1])
    with pytest.warns(UserWarning, match="usable samples"):
        assert shrink_window(lengths, [30], [3], "delta_t") == ([30], [1])
    with pytest.raises(ValueError, match="no n_layers"):
        shrink_window(lengths, [5], [40], "n_layers")
    with pytest.raises(ValueError):
        shrink_window(lengths, [5], [4], "both")

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causalnet.functions.complexity import log_c, log_c_array
from causalnet.functions.kernel import Sample, best_cuts, block, dense, equal_frequency_bins, histogram_cuts, mean_of_cycle
from causalnet.operators.orientation import collider_score, induced, logistic


@pytest.mark.parametrize(("n", "r", "v"), [(2, 2, 0.916291), (2, 3, 1.504077), (100, 2, 2.580971), (100, 5, 8.422305), (1000, 3, 6.947268), (60000, 7, 30.320628)])
def test_regret(n, r, v):
    assert abs(log_c(n, r) - v) < 1e-5
    assert abs(log_c_array(np.array([n, n]), r)[1] - log_c(n, r)) < 1e-12


def test_pair_by_hand():
    x, y = np.array([0] * 40 + [1] * 60), np.array([0] * 30 + [1] * 10 + [0] * 5 + [1] * 55)
    r = Sample([x, y], [False, False]).mutual()
    assert abs(r.info - 25.041099) < 1e-5 and abs(r.cplx - 1.900595) < 1e-5
    assert abs(Sample([x, y], [False, False], cplx="bic").mutual().cplx - 2.302585) < 1e-5


def test_orientation_by_hand():
    s = collider_score(-5)
    assert abs(s - 4.313568) < 1e-5 and abs(logistic(s) - 0.986791) < 1e-5
    assert abs(induced(3, s) - 2.751388) < 1e-5


@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(2, 19))
@settings(max_examples=100, deadline=None)
def test_equal_frequency(counts, bins):
    counts = np.array(counts)
    got = equal_frequency_bins(counts, bins)
    n, b = int(counts.sum()), min(bins, len(counts))
    size, level, at, want = n // b, 0, 0, []
    for c in counts:  # a cut at every size-th row, seen at the first row of a value
        if at >= min((level + 1) * size, n) and level < b - 1:
            level += 1
        want.append(level)
        at += c
    assert got.tolist() == want


def objective(cut, target, other, base, levels, m, before):
    """The sum that best_cuts maximises, for bins that begin at 0 and at ``cut``, by plain counting; a cut costs what one of
    ``before`` bins cost on average."""
    total = -len(cut) * math.log(math.comb(m - 1, before - 1)) / (before - 1)
    for a, b in zip([0, *cut], [*cut, m]):
        rows = (target >= a) & (target < b)
        for v in set(base[rows].tolist()):
            own = rows & (base == v)
            n = int(own.sum())
            total -= n * math.log(n) + log_c(n, levels)
            for o in set(other[own].tolist()):
                k = int((own & (other == o)).sum())
                total += k * math.log(k)
    return total


@pytest.mark.parametrize("seed", range(12))
def test_cuts_against_all_partitions(seed):
    rng = np.random.default_rng(seed)
    m, levels = int(rng.integers(2, 9)), int(rng.integers(2, 4))
    target = rng.integers(0, m, 240)
    target[:m] = np.arange(m)
    other = np.where(rng.random(240) < 0.6, (target * levels) // m, rng.integers(0, levels, 240))
    base = rng.integers(0, 2, 240) if seed % 2 else np.zeros(240, int)
    before = int(rng.integers(2, m + 1))
    one = np.ones(240)
    got = best_cuts(target, base * levels + other, base, one, one, levels, before, "nml")
    cuts = [c for k in range(m) for c in itertools.combinations(range(1, m), k)]
    top = max(objective(c, target, other, base, levels, m, before) for c in cuts)
    mine = tuple(np.flatnonzero(np.diff(got)) + 1)
    assert objective(mine, target, other, base, levels, m, before) > top - 1e-3 and got[0] == 0
    assert best_cuts(target, base * levels + other, base, one, one, levels, 1, "nml").tolist() == [0] * m


def test_mean_of_a_cycle():
    assert mean_of_cycle([(1.0, 0.5)]) is None and mean_of_cycle([(1.0, 0.5), (2.0, 0.6)]) is None
    assert mean_of_cycle([(9.0, 9.0), (1.0, 0.5), (3.0, 1.5), (1.1, 0.5 + 1e-6)]) == (2.0, 1.0)
    assert mean_of_cycle([(9.0, 9.0), (1.0, 0.5), (1.0, 0.5)]) == (1.0, 0.5)


def test_bins_that_take_turns_give_the_mean():
    """x and y that each cut where the other did not: the values alternate and the result lies between."""
    found = None
    for seed in range(400):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(30, 90))
        x = rng.integers(0, 12, n)
        y = (x * rng.integers(1, 4) + rng.integers(0, 9, n)) % 12
        s = Sample([x, y], [True, True])
        got = s.mutual(negative_info=True)
        if len({tuple(map(tuple, r)) for r in ([c.tolist() for c in both] for both in got.cuts)}) < len(got.cuts) and len(got.cuts) > 2:
            at = [[c.tolist() for c in both] for both in got.cuts]
            first = max(i for i in range(len(at) - 1) if at[i] == at[-1])
            if len(at) - 1 - first > 1:
                found = s, got, first
                break
    assert found, "no oscillating case"
    s, got, first = found
    values = []
    for cx, cy in got.cuts[first:-1]:
        bins = [np.searchsorted(c, np.arange(sc.levels), side="left") for c, sc in zip((cx, cy), s.scales)]
        i, k = block(bins[0][s.codes[0]], bins[1][s.codes[1]], s.w, len(cx) + 1, len(cy) + 1, "nml")
        cost = sum(math.log(math.comb(min(50, sc.levels) - 1, len(c))) if 0 < len(c) < min(50, sc.levels) - 1 else 0.0 for c, sc in zip((cx, cy), s.scales))
        values.append((i, i - k - cost))
    assert len({round(v, 5) for _, v in values}) > 1
    assert got.info == pytest.approx(np.mean([v[0] for v in values])) and got.shifted == pytest.approx(np.mean([v[1] for v in values]))


def test_one_level_of_a_condition_pays_for_the_other():
    i, k = block(np.array([0, 0, 1, 2]), np.zeros(4, int), np.ones(4), 3, 1, "nml", True)
    assert i == 0.0 and k == pytest.approx(log_c(4, 3))


def test_mutual_against_exhaustive_turns():
    """The same rounds with every partition tried: both variables take their best bins given the other's former ones."""
    m, cuts = 6, [c for k in range(6) for c in itertools.combinations(range(1, 6), k)]
    rng = np.random.default_rng(7)
    for _ in range(8):
        x = rng.integers(0, m, 300)
        y = np.clip(np.where(rng.random(300) < 0.7, 5 - x if rng.random() < 0.5 else x, rng.integers(0, m, 300)), 0, 5)
        s, one = Sample([x, y], [True, True]), np.zeros(300, int)

        def bins(c):
            return np.searchsorted(np.array(c), np.arange(m), side="right")

        def value(a, b):
            i, k = block(bins(a)[x], bins(b)[y], s.w, len(a) + 1, len(b) + 1, "nml")
            return i, i - k - sum(math.log(math.comb(m - 1, len(c))) if 0 < len(c) < m - 1 else 0.0 for c in (a, b))

        def plain(a, b):
            i, k = block(bins(a)[x], bins(b)[y], s.w, len(a) + 1, len(b) + 1, "nml")
            return i - k

        def best(target, other, c, before):
            levels = len(c) + 1
            if before < 2:
                return ()
            return max(cuts, key=lambda t: objective(t, target, bins(c)[other], one, levels, m, before))

        starts = [tuple(tuple((np.flatnonzero(np.diff(equal_frequency_bins(np.bincount(v), b))) + 1).tolist()) for v in (x, y)) for b in range(2, 6)]
        a, b = max(starts, key=lambda t: plain(*t))
        history = []
        for _ in range(50):
            a, b = best(x, y, b, len(a) + 1), best(y, x, a, len(b) + 1)
            history.append(value(a, b))
            if want := mean_of_cycle(history):
                break
        got = s.mutual()
        assert got.shifted == pytest.approx(max(want[1], 0.0), abs=1e-4)
        top = max(value(a, b)[1] for a in cuts for b in cuts)
        assert got.shifted <= top + 1e-6


def test_symmetry_and_weights():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=400), rng.normal(size=400)
    y = y + x
    z = rng.integers(0, 3, 400)
    s = Sample([dense(x), dense(y), z], [True, True, False])
    t = Sample([dense(y), dense(x), z], [True, True, False])
    assert abs(s.mutual().info - t.mutual().info) < 0.05 * s.mutual().info
    half = Sample([np.append(z, z), np.append(z, z)], [False, False], np.full(800, 0.5)).mutual()
    assert abs(half.info - Sample([z, z], [False, False]).mutual().info) < 1e-9


def test_chain_and_collider():
    rng = np.random.default_rng(2)
    n = 800
    z = rng.random(n)
    x, y = 2 * z + rng.normal(0, 0.2, n), 2 * z + rng.normal(0, 0.2, n)
    s = Sample([dense(x), dense(y), dense(z)], [True] * 3)
    assert s.mutual(0, 1).shifted > 100 and s.conditional(0, 1, [2]).shifted < 20
    x, y = rng.random(n), rng.random(n)
    s = Sample([dense(x), dense(y), dense(x + y + rng.normal(0, 0.1, n))], [True] * 3)
    assert s.mutual(0, 1).shifted == 0 and s.conditional(0, 1, [2]).shifted > 50
    assert s.three_point(0, 1, 2)["i3"] < 0


def test_block_is_zero_for_one_level():
    assert block(np.zeros(5, int), np.arange(5), np.ones(5), 1, 5, "nml") == (0.0, 0.0)


def test_histogram_finds_the_gap():
    rng = np.random.default_rng(3)
    cuts = histogram_cuts(np.round(np.concatenate([rng.normal(0, 1, 300), rng.normal(20, 1, 300)]), 3))
    assert cuts == sorted(cuts) and any(b - a > 5 for a, b in zip(cuts, cuts[1:]) if a < 10 < b)

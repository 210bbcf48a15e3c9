"""The divergence from 5th neighbours against brute force, whatever the cells."""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from causalnet.operators import neighbours


def text(v):
    """A double as Spark writes it."""
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return repr(float(v))
    sign, digits, e = Decimal(repr(float(v))).as_tuple()
    rest = "".join(map(str, digits[1:])).rstrip("0") or "0"
    return f"{'-' if sign else ''}{digits[0]}.{rest}E{len(digits) - 1 + e}"


def moved(v, salt, parts):
    h = int(hashlib.md5("|".join([str(salt), *parts]).encode()).hexdigest()[:8], 16)
    return v + (h / 2**31 - 1) * max(neighbours.NOISE, abs(v) * 1e-10)


def apart(rows, d):
    """Points without ties, as the operator makes them; of equal ones the known come first."""
    out, seen = [], {}
    for x, y, known in sorted(rows, key=lambda r: not r[2]):
        key = (x, y if d > 1 else None)
        copy = seen[key] = seen.get(key, -1) + 1
        parts = [text(x), text(y) if d > 1 else "", str(copy)]
        out.append((moved(x, 0, parts), moved(y, 1, parts) if d > 1 else 0.0, known))
    return np.array([p[:2] for p in out]), np.array([bool(p[2]) for p in out])


def brute(rows, d):
    p, known = apart(rows, d)
    n1, n2 = int(known.sum()), len(p)
    dist = lambda a: np.sort(np.sqrt(((p[known][:, None] - a[None]) ** 2).sum(2)), axis=1)[:, neighbours.K - 1]
    return d * float(np.log(dist(p) / dist(p[known])).sum()) + n1 * math.log((n2 - 1) / (n1 - 1))


def frame(spark, groups):
    rows = [(k, d, float(x), float(y), bool(n)) for k, d, g in groups for x, y, n in g]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "d", "x", "y", "known"])).repartition(3)


def clouds(seed):
    r = np.random.default_rng(seed)
    n = 2000
    even = np.stack([r.normal(size=n), r.normal(size=n), r.random(n) < 0.5], axis=1)
    ties = np.stack([r.integers(0, 6, n), r.integers(0, 4, n), r.random(n) < 0.3], axis=1)
    x = np.concatenate([r.normal(0, 0.01, n // 2), r.normal(50, 20, n // 2)])
    skewed = np.stack([x, x**2, x < 40], axis=1)
    one = np.concatenate([np.full((700, 3), (3.0, 3.0, 1.0)), np.full((700, 3), (3.0, 3.0, 0.0)), np.stack([r.random(60), r.random(60), r.random(60) < 0.5], axis=1)])
    return {"even": even, "ties": ties, "skewed": skewed, "one": one}


@pytest.mark.parametrize("cell", [40, 1000])
def test_divergence_against_brute_force(spark, cell):
    sets = clouds(cell)
    groups = [(f"{name}{d}", d, [tuple(map(float, p)) for p in g]) for name, g in sets.items() for d in (1, 2)]
    got = neighbours.divergences(frame(spark, groups), cell)
    for k, d, g in groups:
        n1, n2, kl = got[k]
        assert (n1, n2) == (sum(p[2] > 0 for p in g), len(g))
        assert kl == pytest.approx(brute(g, d), rel=1e-9, abs=1e-6), k


def test_few_points_have_no_divergence(spark):
    got = neighbours.divergences(frame(spark, [("a", 2, [(i, i, i < 5) for i in range(30)]), ("b", 1, [(0.0, 0.0, True)]), ("c", 1, [(i, 0, i < 6) for i in range(9)])]), 4)
    assert got["a"] == (5, 30, None) and got["b"] == (1, 1, None) and got["c"][2] == pytest.approx(brute([(float(i), 0.0, i < 6) for i in range(9)], 1))


def test_cells_stay_small(spark):
    r = np.random.default_rng(2)
    g = [("k", 2, [(v, w, True) for v, w in r.lognormal(0, 3, (6000, 2))] + [(1.0, 1.0, True)] * 2000)]
    points = neighbours.separate(frame(spark, g))
    assert points.count() == 8000 and points.dropDuplicates(["x", "y"]).count() == 8000
    found = neighbours.grids(points, 100)
    dealt = points.mapInArrow(neighbours._dealt(found), neighbours.ROWS).where("held").groupBy("space", "cell").count()
    assert max(row["count"] for row in dealt.collect()) < 400


def test_copies_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "COPIES", 7)
    rows = [(2.0, 2.0, i < 20) for i in range(50)] + [(1.0, 0.0, True)] * 3
    got = neighbours.separate(frame(spark, [("k", 2, rows)])).collect()
    assert len(got) == 53 and sum(r["known"] for r in got) == 23
    p, known = apart(rows, 2)
    nine = lambda rows: sorted((round(a, 9), round(b, 9), c) for a, b, c in rows)
    assert nine((r["x"], r["y"], r["known"]) for r in got) == nine((a, b, c) for (a, b), c in zip(p.tolist(), known.tolist()))


def test_tests_of_a_table_with_gaps(spark):
    r = np.random.default_rng(6)
    n = 2000
    x, y = r.normal(size=n), r.normal(size=n)
    c = r.choice(list("abc"), n)
    free = r.random(n) < 0.5
    bound = x > 0.2
    p = pd.DataFrame({"x": x, "y": y, "c": c, "free": np.where(free, "k", None), "bound": np.where(bound, "k", None), "u": np.where(r.random(n) < 0.9, "u", None)})
    df = spark.createDataFrame(p)
    tests = [("x", "y", "free", ()), ("x", "y", "bound", ()), ("c", "x", "bound", ()), ("y", "c", "free", ["u"])]
    got = neighbours.missing_at_random(df, tests, {"x", "y"}, cell=150)
    assert [v[0] for v in got] == [free.sum(), bound.sum(), bound.sum(), (free & p.u.notna()).sum()] and got[3][1] == p.u.notna().sum()
    assert got[0][2] == pytest.approx(brute(list(zip(x, y, free)), 2), rel=1e-9)
    want = 0.0
    for level in "abc":
        at = c == level
        n1, n2 = (at & bound).sum(), at.sum()
        want += max(0.0, brute([(v, 0.0, k) for v, k in zip(x[at], bound[at])], 1)) + n1 * math.log(n1 / bound.sum() * n / n2)
    assert got[2][2] == pytest.approx(want, rel=1e-9)
    assert min(got[1][2], got[2][2]) > 10 * max(abs(got[0][2]), abs(got[3][2]), math.log(n))
    one = neighbours.kl_missing_at_random(df, "x", "y", "bound", continuous=["x", "y"]).collect()[0]
    assert one["rejected"] and one["kl"] == pytest.approx(got[1][2], rel=1e-9)

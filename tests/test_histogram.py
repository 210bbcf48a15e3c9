"""The histogram of many values, in ranges, beside the plain programme in one task."""

import time

import numpy as np
import pytest

from causalnet.functions.kernel import histogram_cuts
from causalnet.operators import standalone
from causalnet.plans.histogram import histogram


def shapes(rng):
    yield "two blobs", np.round(np.concatenate([rng.uniform(-1000, 10_000, 500), rng.uniform(99_000, 110_000, 500)]), 2)
    yield "normal", np.round(np.concatenate([rng.normal(0, 1, 600), rng.normal(9, 0.3, 500)]), 3)
    yield "heavy", np.round(rng.pareto(1.2, 1200), 3)
    yield "equal steps", np.concatenate([np.arange(400.0), np.arange(400, 900, 0.5)])
    yield "repeats", rng.integers(0, 700, 4000) ** 1.5 // 1


@pytest.mark.parametrize("kind", range(5))
def test_ranges_give_the_same_cuts(spark, kind):
    _, v = list(shapes(np.random.default_rng(4)))[kind]
    u, n = np.unique(v, return_counts=True)
    values = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, n)], "v double, w double").persist()
    assert histogram(values, 8, span=150, block=32) == histogram_cuts(u, n.astype(float), 8)


def test_many_values_take_seconds(spark):
    """The plain programme takes minutes for 30,000 values and grows with their square."""
    line = spark.range(30_000).selectExpr("(id * 7919) % 30011 * 0.01 + (id % 2) * 100000 AS two")
    start = time.time()
    cuts = [r["cut"] for r in standalone.discretise_mdl(line, "two", 6).orderBy("cut").collect()]
    assert len(cuts) == 4 and cuts[1] < 301 and cuts[2] > 99_999 and time.time() - start < 100

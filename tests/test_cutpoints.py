import numpy as np
import pandas as pd

from causalnet.functions.kernel import Sample
from causalnet.operators.standalone import discretise_mutual


def test_cuts_of_many_values_against_the_kernel(spark):
    r = np.random.default_rng(5)
    n = 8192
    x = r.permutation(n).astype(float)
    y = (x > 0.7 * n).astype(float) * 3 + r.integers(0, 3, n)
    got = discretise_mutual(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").toPandas()
    start = min(30, round(n ** (1 / 3)))
    s = Sample([x.astype(int), y.astype(int)], [True, True], np.ones(n), "nml", min(n, min(5 * start, 50)), start, n)
    cuts = s.conditional(0, 1, []).cuts
    want = sorted((i + 1, float(c) + 0.5) for i, both in enumerate(cuts) for c in both[0])
    mine = got[(got.variable == "x") & (got.cut >= 0) & (got.cut < n - 1)]
    assert sorted(zip(mine.iteration, mine.cut)) == want
    assert any(abs(c - 0.7 * n) < n / 40 for c in mine.cut)

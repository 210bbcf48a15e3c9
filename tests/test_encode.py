import numpy as np
import pandas as pd
import pytest

from causalnet.operators import encode
from causalnet.operators.summary import ranks


@pytest.mark.parametrize("span", [40, None])
def test_running_sums_of_ranges(spark, span):
    r = np.random.default_rng(1)
    p = pd.DataFrame({"s": [f"k{i:03d}" for i in r.permutation(300)], "x": r.permutation(300) / 7, "n": r.integers(1, 9, 300)})
    df = spark.createDataFrame(p).repartition(3)
    for order in ("s", "x"):
        want = p.sort_values(order)
        got = encode.running(df, order, {"upto": "n"}, span=span).toPandas().sort_values(order)
        assert got.upto.tolist() == want.n.cumsum().tolist()
        low = encode.running(df, order, {"low": "n"}, "min", span).toPandas().sort_values(order)
        assert low.low.tolist() == want.n.cummin().tolist()


def test_codes_and_ranks_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(encode, "RANGE", 25)
    r = np.random.default_rng(2)
    p = pd.DataFrame({"c": [f"v{i}" for i in r.integers(0, 120, 900)], "x": r.integers(0, 200, 900) / 3})
    codes = encode.level_codes(spark.createDataFrame(p), "c").toPandas().sort_values("level")
    assert codes.code.tolist() == list(range(len(codes))) and codes.n.tolist() == p.groupby("c").size().sort_index().tolist()
    got = sorted(ranks(spark.createDataFrame(p), ["x"]).toPandas().x)
    assert got == sorted(p.x.rank())
    bins = encode.equal_frequency(spark.createDataFrame(p), "x", 7).toPandas().sort_values("value")
    from causalnet.functions.kernel import equal_frequency_bins

    assert bins.bin.tolist() == equal_frequency_bins(bins.n.to_numpy(), 7).tolist()

"""Information of given columns, without a network: two- and three-variable queries and discretisation."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalnet.functions.kernel import histogram_cuts
from causalnet.operators.encode import encode
from causalnet.plans import rounds, scales
from causalnet.plans.histogram import histogram
from causalnet.plans.rounds import Request, Setting
from causalnet.plans.shipping import ship
from causalnet.sources.observations import numeric_columns, usable_weights

#: Distinct values that one task takes through the plain quadratic programme.
HELD = 2048


def _kinds(df: DataFrame, columns: Sequence[str], continuous: Sequence[bool] | None) -> list[bool]:
    numbers = set(numeric_columns(df))
    return [c in numbers for c in columns] if continuous is None else list(continuous)


def _answer(df: DataFrame, kind: str, columns: Sequence[str], kinds: Sequence[bool], cplx: str, n_eff: float | None, maxbins: int | None, weights: str | None) -> tuple[dict, list[scales.Places | None]]:
    """(result, places of each column) of one request over the rows that know all columns."""
    ship(df.sparkSession)
    weights = weights if usable_weights(df, weights) else None
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    if lacking := df.where(~known).count():
        warnings.warn(f"{lacking} rows that lack a value are left out", stacklevel=4)
    whole = df.where(known)
    rows = rounds.observed(whole.where(F.col(weights) > 0) if weights else whole, list(zip(columns, kinds)), weights)
    names = [f"v{i}" for i in range(len(columns))]
    rows = rows.dropna(subset=names).persist()
    try:
        n = rows.count()
        if n < 3:
            raise ValueError("fewer than 3 complete rows")
        start = min(30, round(n ** (1 / 3)))
        o = Setting(cplx, min(n, maxbins or min(5 * start, 50)), start, False, n_eff / n if n_eff and not weights else 1.0)
        wanted = [(c, ()) for c, number in zip(names, kinds) if number]
        if wanted:
            o.scales = dict(zip(wanted, scales.places(scales.tally(rows, wanted), len(wanted), o.maxbins)))
        found = rounds.solve(rows, [Request(kind, tuple(names))], dict(zip(names, kinds)), set(), o, weights is not None, n_rows=n)[0]
        return found, [o.scales.get((c, ())) for c in names]
    finally:
        rows.unpersist()


def mutual_information(df: DataFrame, x: str, y: str, given: Sequence[str] = (), cplx: str = "nml", n_eff: float | None = None, maxbins: int | None = None, continuous: Sequence[bool] | None = None, sample_weights: str | None = None) -> DataFrame:
    """One row: n, info, infok (shifted), n_iterations; in nats times samples.

    A column of ``sample_weights`` (0 to 1) weighs the rows, and ``n_eff`` then counts for nothing."""
    columns = [x, y, *given]
    r, _ = _answer(df, "2", columns, _kinds(df, columns, continuous), cplx, n_eff, maxbins, sample_weights)
    return df.sparkSession.createDataFrame([(r["n"], r["info"], r["info"] - r["cplx"], len(r["cuts"]))], "n double, info double, infok double, n_iterations int")


def three_point_information(df: DataFrame, x: str, y: str, z: str, given: Sequence[str] = (), cplx: str = "nml", n_eff: float | None = None, continuous: Sequence[bool] | None = None, sample_weights: str | None = None) -> DataFrame:
    """One row: n, i3, i3k, i2, i2k, score."""
    columns = [x, y, z, *given]
    r, _ = _answer(df, "3", columns, _kinds(df, columns, continuous), cplx, n_eff, None, sample_weights)
    return df.sparkSession.createDataFrame([(r["n"], r["i3"], r["i3"] - r["k3"], r["i2"], r["i2"] - r["k2"], r["score"])], "n double, i3 double, i3k double, i2 double, i2k double, score double")


def discretise_mutual(df: DataFrame, x: str, y: str, given: Sequence[str] = (), cplx: str = "nml", maxbins: int | None = None, continuous: Sequence[bool] | None = None, sample_weights: str | None = None, ends: bool = True) -> DataFrame:
    """(iteration, variable, cut): the cut points of x and y at each iteration, midpoints of neighbouring values.

    With ``ends`` they begin below the least value, by a hundredth of the smaller standard deviation of x and y (of a discrete
    one, that of its codes), and end at the greatest."""
    columns = [x, y, *given]
    kinds = _kinds(df, columns, continuous)
    if not (kinds[0] or kinds[1]):
        raise ValueError("at least one of the two variables must be continuous")
    r, places = _answer(df, "2", columns, kinds, cplx, None, maxbins, sample_weights)
    outer = {}
    if ends:
        whole = df.dropna(subset=columns).select(x, y)
        discrete = [c for c, number in zip((x, y), kinds) if not number]
        one = (encode(whole, discrete) if discrete else whole).agg(*(f(F.col(c).cast("double")).alias(f"{name}{i}") for i, c in enumerate((x, y)) for name, f in (("s", F.stddev_samp), ("a", F.min), ("b", F.max)))).collect()[0]
        step = min(one["s0"], one["s1"]) / 100
        outer = {i: (one[f"a{i}"] - step, one[f"b{i}"]) for i in (0, 1)}
    rows = []
    for i, cuts in enumerate(r["cuts"], 1):
        for k, c in enumerate((x, y)):
            if kinds[k]:
                inner = [places[k].middle(at) for at in cuts[k]]
                rows += [(i, c, v) for v in ([outer[k][0], *inner, outer[k][1]] if ends else inner)]
    return df.sparkSession.createDataFrame(rows, "iteration int, variable string, cut double")


def discretise_mdl(df: DataFrame, x: str, max_bins: int = 20, held: int = HELD) -> DataFrame:
    """(cut): the MDL histogram's cut points of one column, from its distinct values' counts; up to ``held`` of them in one task."""
    ship(df.sparkSession)
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    try:
        if not (few := values.count() <= held):
            cuts = histogram(values, max_bins)
    finally:
        values.unpersist()
    if not few:
        return df.sparkSession.createDataFrame([(c,) for c in cuts], "cut double")

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"cut": histogram_cuts(pdf["v"].to_numpy(), pdf["w"].to_numpy(), max_bins)})

    return values.withColumn("one_", F.lit(1)).groupBy("one_").applyInPandas(run, "cut double")


def bin_density(df: DataFrame, x: str, y: str, x_cuts: Sequence[float], y_cuts: Sequence[float]) -> DataFrame:
    """(bin_x, bin_y, n, density): counts over a cut grid, per unit of area."""
    def place(c: str, cuts: Sequence[float]):
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda v: v < F.col(c)))

    def width(c: str, cuts: Sequence[float]):
        return F.get(F.array(*(F.lit(float(b - a)) for a, b in zip(cuts, cuts[1:]))), F.col(c) - 1)

    g = df.dropna(subset=[x, y]).groupBy(place(x, x_cuts).alias("bin_x"), place(y, y_cuts).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("density", F.col("n") / total / (width("bin_x", x_cuts) * width("bin_y", y_cuts)))


"""Time series: trajectories, smoothing, lags, autocorrelation, stationary edges.

A trajectory is a window partition (its key) ordered by time, so work is spread over trajectories.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalnet.plans.shipping import ship

VANISHED = 0.05
#: Lags of the first block, and steps of a chunk.
BLOCK = 32
CHUNK = 8192


def split_trajectories(df: DataFrame, order: str, step: str, by: Sequence[str] = (), trajectory: str = "traj_id", time: str = "t") -> DataFrame:
    """A new trajectory begins where ``step`` falls in the order of ``order``; times count from 1."""
    w = Window.partitionBy(*by).orderBy(order)
    cut = F.when(F.lag(step).over(w) > F.col(step), 1).otherwise(0)
    out = df.withColumn("cut_", cut).withColumn(trajectory, F.sum("cut_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return out.withColumn(time, F.row_number().over(Window.partitionBy(*by, trajectory).orderBy(order))).drop("cut_")


def check_trajectories(df: DataFrame, order: str, step: str, by: Sequence[str] = ()) -> dict[str, int]:
    """What is odd about the time steps, counted in one job, with a warning for each: ``unchanged`` and ``gaps`` between neighbouring
    steps, ``starts`` of trajectories at another step than 1. Errors for unknown or broken numbers of steps, and if no
    trajectory has a second step."""
    number = F.col(step).try_cast("double")
    w = Window.partitionBy(*by).orderBy(order)
    next_step = F.lead(number).over(w)
    begins = F.lag(number).over(w).isNull() | (F.lag(number).over(w) > number)
    rows = df.select(F.col(step).isNull().alias("unknown"), (number != F.round(number)).alias("broken"), (next_step == number).alias("unchanged"), (next_step > number + 1).alias("gap"), begins.alias("begins"), (begins & (number != 1)).alias("start"))
    one = rows.agg(*(F.count_if(c).alias(c) for c in rows.columns), F.count(F.lit(1)).alias("n")).collect()[0]
    if one["unknown"]:
        raise ValueError(f"{step} is unknown in {one['unknown']} rows")
    if one["broken"] or df.where(F.col(step).isNotNull() & number.isNull()).limit(1).count():
        raise ValueError(f"{step} must hold whole numbers")
    if one["n"] and one["begins"] == one["n"]:
        raise ValueError("all trajectories have only one time step")
    found = {"unchanged": one["unchanged"], "gaps": one["gap"], "starts": one["start"]}
    said = {"unchanged": "time step unchanged at {} positions", "gaps": "gap in the time steps at {} positions", "starts": "{} trajectories don't start with 1 as first time step"}
    for name, n in found.items():
        if n:
            warnings.warn(said[name].format(n), stacklevel=2)
    return found


def moving_average(df: DataFrame, by: Sequence[str], time: str, widths: dict[str, int], keep_ends: bool = True) -> DataFrame:
    """Centred means; null where the window leaves the trajectory; nulls inside are skipped.

    Without ``keep_ends``, rows whose widest window leaves the trajectory go."""
    w = Window.partitionBy(*by).orderBy(time)
    new: dict[str, Column] = {}
    for c, width in widths.items():
        if width and width > 1:
            low = (width - 1) // 2
            frame = w.rowsBetween(-low, width - 1 - low)
            new[c] = F.when(F.count(F.lit(1)).over(frame) == width, F.avg(c).over(frame))
    out = df.withColumns(new) if new else df
    if not keep_ends and new:
        widest = max(v for v in widths.values() if v)
        low = (widest - 1) // 2
        out = out.withColumn("n_", F.count(F.lit(1)).over(w.rowsBetween(-low, widest - 1 - low))).where(F.col("n_") == widest).drop("n_")
    return out


def lag_table(df: DataFrame, by: Sequence[str], time: str, layers: dict[str, tuple[int, int]], contextual: Sequence[str] = (), keep_ends: bool = False) -> DataFrame:
    """Columns ``v_lagK``, K = 0, delta, ..., (n-1) delta for layers[v] = (n, delta); contextual ones only at lag 0."""
    w = Window.partitionBy(*by).orderBy(time)
    cols, top = [], 0
    for v, (n, delta) in layers.items():
        for k in range(1 if v in contextual else n):
            cols.append((F.lag(v, k * delta).over(w) if k else F.col(v)).alias(f"{v}_lag{k * delta}"))
            top = max(top, k * delta)
    out = df.select(*by, time, *cols, F.row_number().over(w).alias("at_"))
    out = out if keep_ends else out.where(F.col("at_") > top)
    return out.drop("at_").dropna(how="all", subset=[c for c in out.columns if c not in (*by, time, "at_")])


def autocorrelation(df: DataFrame, by: Sequence[str], time: str, value: str, lags: Sequence[int]) -> DataFrame:
    """(by, lag, acf): the biased estimate with the trajectory's mean and all its rows as divisor."""
    w = Window.partitionBy(*by).orderBy(time)
    d = df.where(F.col(value).isNotNull()).withColumn("d_", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    shifted = d.select(*by, "d_", *(F.lag("d_", k).over(w).alias(f"k{k}") for k in lags))
    sums = shifted.groupBy(*by).agg(F.sum(F.col("d_") ** 2).alias("v"), *(F.sum(F.col("d_") * F.col(f"k{k}")).alias(f"s{k}") for k in lags))
    rows = F.array(*(F.struct(F.lit(k).alias("lag"), F.when(F.col("v") > 0, F.coalesce(f"s{k}", F.lit(0.0)) / F.col("v")).alias("acf")) for k in lags))
    return sums.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def _products(by: Sequence[str], low: int, high: int):
    """Sums of d(t) d(t + k), k from ``low`` to ``high``, of the steps of one chunk."""

    def run(key, pdf):
        import pandas as pd

        size = high - low + 1
        pdf = pdf.sort_values("p_")
        own, later = pdf[pdf["own_"]], pdf[~pdf["own_"]]
        first = int(own["p_"].iloc[0]) if len(own) else 0
        x = own["d_"].to_numpy()
        y = np.zeros(len(x) + size - 1)  # d at first + low, ...
        at = later["p_"].to_numpy() - first - low
        inside = (at >= 0) & (at < len(y))
        y[at[inside]] = later["d_"].to_numpy()[inside]
        sums = np.correlate(y, x, "valid") if len(x) else np.zeros(size)
        return pd.DataFrame({**dict(zip(by, key)), "lag": np.arange(low, high + 1, dtype="int32"), "s_": sums})

    return run


def autocorrelation_until(df: DataFrame, by: Sequence[str], time: str, value: str, max_lag: int, below: float = VANISHED, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """((by, lag, acf), tables to unpersist): the autocorrelation up to the end of the block of lags in which a series' autocorrelation falls under ``below``, or to ``max_lag``.

    Blocks of lags double; each is one job over the series that have not vanished yet, in chunks of steps that meet copies of
    the steps a block later. So the plan and a task's rows don't follow the length of a trajectory. Series without variance have no rows."""
    by = list(by)
    ship(df.sparkSession)
    known = df.where(F.col(value).isNotNull())
    place = known.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1).cast("long").alias("p_"), F.col(value).cast("double").alias("x_"))
    means = known.groupBy(*by).agg(F.avg(value).alias("m_"))
    centred = place.join(means, by).select(*by, "p_", (F.col("x_") - F.col("m_")).alias("d_")).persist()
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", lag int, s_ double"
    alive = centred.groupBy(*by).agg(F.sum(F.col("d_") ** 2).alias("v_"), F.count(F.lit(1)).alias("n_")).where("v_ > 0").persist()
    held, parts, low = [centred, alive], [], 1
    while low <= max_lag:
        high = min(max_lag, low + block - 1)
        rows = centred.join(alive.select(*by), by, "left_semi")
        own = rows.select(*by, F.floor(F.col("p_") / chunk).alias("c_"), F.lit(True).alias("own_"), "p_", "d_")
        ends = F.array_distinct(F.array(F.floor((F.col("p_") - low) / chunk), F.floor((F.col("p_") - high) / chunk)))
        span = F.sequence(F.array_min(ends), F.array_max(ends))  # the chunks that have steps of this one's lags
        later = rows.withColumn("c_", F.explode(span)).where("c_ >= 0").select(*by, "c_", F.lit(False).alias("own_"), "p_", "d_")
        sums = own.unionByName(later).groupBy(*by, "c_").applyInPandas(_products(by, low, high), schema)
        acf = sums.groupBy(*by, "lag").agg(F.sum("s_").alias("s_")).join(alive, by).where("lag < n_").select(*by, "lag", (F.col("s_") / F.col("v_")).alias("acf")).persist()
        parts.append(acf)
        held.append(acf)
        gone = acf.groupBy(*by).agg(F.min("acf").alias("a_"), F.max("lag").alias("l_")).where((F.col("a_") < below) | (F.col("l_") < high))
        alive = alive.join(gone.select(*by), by, "left_anti").persist()
        held.append(alive)
        low, block = high + 1, block * 2
        if alive.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, held


def decays(df: DataFrame, by: Sequence[str], time: str, values: Sequence[str], max_lag: int) -> tuple[DataFrame, list[DataFrame]]:
    """((variable, by, alpha), tables to unpersist): the decay per step up to half the lag at which the autocorrelation has vanished, or ``max_lag`` if it
    hasn't; null where it is negative there (an even root)."""
    out, held = None, []
    for v in values:
        acf, more = autocorrelation_until(df, by, time, v, max_lag)
        held += more
        gone = acf.groupBy(*by).agg(F.min(F.when(F.col("acf") < VANISHED, F.col("lag"))).alias("g"))
        at = F.greatest(F.lit(1), F.bround(F.coalesce("g", F.lit(max_lag)) / 2).cast("int"))
        a = acf.join(gone, list(by)).where(F.col("lag") == at)
        alpha = F.when((F.col("acf") >= 0) | (F.col("lag") == 1), F.signum("acf") * F.pow(F.abs("acf"), 1 / F.col("lag")))
        t = a.select(F.lit(v).alias("variable"), *by, alpha.alias("alpha"))
        out = t if out is None else out.unionByName(t)
    return out, held


def relaxation_times(df: DataFrame, by: Sequence[str], time: str, values: Sequence[str], max_lag: int) -> dict[str, int]:
    """Rounded (1+a)/(1-a) of each variable, a the mean decay of its series; variables without one are left out."""
    each, held = decays(df, by, time, values, max_lag)
    try:
        rows = each.groupBy("variable").agg(F.avg("alpha").alias("a")).where("a < 1").select("variable", F.bround((1 + F.col("a")) / (1 - F.col("a"))).cast("int").alias("tau")).collect()
    finally:
        for t in held:
            t.unpersist()
    return {r["variable"]: r["tau"] for r in rows}


def choose_layers(tau: int, n_lagged: int, n_contextual: int = 0, max_nodes: int = 50, n_layers: int | None = None, delta_t: int | None = None) -> tuple[int, int]:
    """(n_layers, delta_t) for a relaxation time, within ``max_nodes`` lagged variables."""
    most = max(2, (max_nodes - n_contextual) // max(n_lagged, 1))
    if n_layers is not None and delta_t is not None:
        return n_layers, delta_t
    if n_layers is not None:
        return n_layers, max(1, math.ceil(tau / max(n_layers - 1, 1)))
    if delta_t is not None:
        return min(most, math.ceil(tau / delta_t) + 1), delta_t
    if (tau + 1) * n_lagged + n_contextual <= max_nodes:
        return max(2, tau + 1), 1
    return most, tau if most == 2 else math.ceil(tau / (most - 1))


def samples_after(lengths: DataFrame, lag: int) -> int:
    """Rows that trajectories of (length, n) have left once ``lag`` steps back are needed."""
    return int(lengths.agg(F.coalesce(F.sum(F.greatest(F.col("length") - lag, F.lit(0)) * F.col("n")), F.lit(0))).collect()[0][0])


def longest_window(lengths: DataFrame, target: float, most: int) -> int:
    """The greatest lag under ``most`` that leaves ``target`` rows; 1 if none does.

    ``lengths`` has (length, n), a row per different length of a trajectory: at most the root of twice the rows. Between
    two neighbouring lengths the rows left fall evenly with the lag, so sums over the longer trajectories give each stretch's best."""
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = lengths.withColumns({"s_": F.sum(F.col("length") * F.col("n")).over(longer), "c_": F.sum("n").over(longer), "below_": F.coalesce(F.lag("length").over(Window.orderBy("length")), F.lit(0))})
    best = F.least(F.col("length") - 1, F.floor((F.col("s_") - F.lit(float(target))) / F.col("c_")), F.lit(most - 1))
    found = sums.withColumn("lag_", best).where((F.col("lag_") >= F.greatest("below_", F.lit(1)))).agg(F.max("lag_")).collect()[0][0]
    return int(found or 1)


def shrink_window(lengths: DataFrame, n_layers: Sequence[int], delta_t: Sequence[int], reduced: str) -> tuple[list[int], list[int]]:
    """(n_layers, delta_t) of each variable, the one named by ``reduced`` made smaller where the lags would leave under a tenth of
    all rows, or 1000 if that is less. Warns if it doesn't help enough; an error if no row would be left."""
    if reduced not in ("n_layers", "delta_t"):
        raise ValueError("n_layers or delta_t can be reduced")
    layers, deltas = list(n_layers), list(delta_t)
    lengths = lengths.persist()
    try:
        spans = [(n - 1) * d for n, d in zip(layers, deltas)]
        rows = int(lengths.agg(F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0))).collect()[0][0])
        before, target = samples_after(lengths, max(spans)), min(1000, rows / 10)
        if before >= target:
            return layers, deltas
        lag = longest_window(lengths, target, max(spans))
        for i, span in enumerate(spans):
            if span > lag and reduced == "n_layers":
                layers[i] = max(2, lag // deltas[i] + 1)
            elif span > lag:
                deltas[i] = max(1, lag // (layers[i] - 1))
        left = samples_after(lengths, max((n - 1) * d for n, d in zip(layers, deltas)))
        other = "delta_t" if reduced == "n_layers" else "n_layers"
        if left <= 0:
            raise ValueError(f"with the given {other} no {reduced} leaves a sample")
        if left < target:
            what = "the temporal parameters leave" if left == before else f"{reduced} has been reduced, and still there are only"
            warnings.warn(f"{what} {left} usable samples; consider giving n_layers and delta_t", stacklevel=3)
        return layers, deltas
    finally:
        lengths.unpersist()


def trajectory_lengths(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(length, n): how many trajectories have how many steps."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def estimate_dynamic(df: DataFrame, by: Sequence[str], time: str, values: Sequence[str], max_nodes: int = 50, n_contextual: int = 0, max_lag: int | None = None, n_lagged: int | None = None, n_layers: int | None = None, delta_t: int | None = None, shrink: bool = True) -> DataFrame:
    """One row: tau, n_layers, delta_t. Lags go up to the shortest trajectory of more than one step, less one; ``n_lagged`` counts
    the variables that get lags, the ``values`` by default. With ``shrink`` the window leaves enough rows."""
    spark, by = df.sparkSession, list(by)
    lengths = trajectory_lengths(df, by)
    if max_lag is None:
        max_lag = int(lengths.where("length > 1").agg(F.min("length")).collect()[0][0] or 2) - 1
    taus = list(relaxation_times(df, by, time, values, max(max_lag, 1)).values()) if values else []
    mean = max(1, round(sum(taus) / len(taus))) if taus else 1
    tau = max(1, min(max_lag + 1, max(taus, default=1), 2 * mean))
    n, d = choose_layers(tau, n_lagged or len(values), n_contextual, max_nodes, n_layers, delta_t)
    if shrink and (n_layers is None or delta_t is None):
        (n,), (d,) = shrink_window(lengths, [n], [d], "n_layers" if n_layers is None and delta_t is not None else "delta_t")
    return spark.createDataFrame([(tau, n, d)], "tau int, n_layers int, delta_t int")


def split_lag(name: Column) -> tuple[Column, Column]:
    """(variable, lag) of a lagged name; lag null without a suffix."""
    base = F.regexp_replace(name, r"_lag[0-9]+$", "")
    return base, F.when(name.rlike(r"_lag[0-9]+$"), F.regexp_extract(name, r"_lag([0-9]+)$", 1).cast("int"))


def lagged_edges(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Edges of lagged names with columns xv, xl, yv, yl and lag = |xl - yl|."""
    (xv, xl), (yv, yl) = split_lag(F.col(x)), split_lag(F.col(y))
    return edges.withColumns({"xv": xv, "xl": xl, "yv": yv, "yl": yl}).withColumn("lag", F.abs(F.col("xl") - F.col("yl")))


def repeat_over_history(edges: DataFrame, n_layers: int, delta_t: int = 1) -> DataFrame:
    """Every edge at all earlier layers with the same difference of lags."""
    e = lagged_edges(edges)
    top = (n_layers - 1) * delta_t
    moved = e.withColumn("shift", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.lit(top) - F.greatest("xl", "yl")), F.lit(delta_t))))
    name = lambda v, k: F.concat(F.col(v), F.lit("_lag"), (F.col(k) + F.col("shift")).cast("string"))
    return moved.withColumns({"x": name("xv", "xl"), "y": name("yv", "yl")}).drop("xv", "xl", "yv", "yl", "lag", "shift")


def flatten(edges: DataFrame, display: str = "compact", value: str = "info_shifted") -> DataFrame:
    """Lagged edges as edges of variables, old to new.

    compact: one row per edge with its lag; drop: without self loops; combine: per pair all lags,
    greatest value; unique: per pair the edge of greatest value (the least lag in a tie)."""
    e = lagged_edges(edges)
    older = (F.col("xl") > F.col("yl")) | ((F.col("xl") == F.col("yl")) & (F.col("xv") <= F.col("yv")))
    flat_of = lambda t: t.select(F.when(older, F.col("xv")).otherwise(F.col("yv")).alias("x"), F.when(older, F.col("yv")).otherwise(F.col("xv")).alias("y"), "lag", value)
    flat = flat_of(e)
    if display == "compact":
        return flat
    if display == "drop":  # Spark moves this filter below the sums that edges come from, to every row: names alone tell self loops
        return flat_of(e.where("xv <> yv"))
    pair = [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]
    if display == "combine":
        return flat.groupBy(*pair).agg(F.array_join(F.array_sort(F.collect_set("lag")), ",").alias("lags"), F.max(value).alias(value))
    if display == "unique":
        best = flat.groupBy(*pair).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("lag")).alias("l"))).alias("b"))
        return best.select("x", "y", (-F.col("b.l")).alias("lag"), F.col("b.v").alias(value))
    raise ValueError(f"unknown display {display}")


def combined(edges: DataFrame) -> DataFrame:
    """(x, y, lags, ort_inferred, p_y2x, p_x2y, info_shifted): one row per pair of variables from lagged edges with these columns.

    A pair's only edge stays as it is, from old to new. Several become one from the first name to the second: it has a head at
    an end where one of them has, and two where they disagree; its probabilities are the greatest at a head, the least at a
    tail opposite a head, and means where there is no direction. Lags are those from the first name to the second, falling, then 0,
    then those back, rising; a slash stands between where there are both. A lag that time would not allow is negative."""
    e = lagged_edges(edges)
    swap = F.col("xl") < F.col("yl")
    known = F.col("p_y2x").isNotNull() & F.col("p_x2y").isNotNull()
    turned = lambda c: F.when(F.abs(c) == 2, -c).otherwise(c)
    flat = e.select(
        F.when(swap, F.col("yv")).otherwise(F.col("xv")).alias("x"), F.when(swap, F.col("xv")).otherwise(F.col("yv")).alias("y"), "lag", F.when(swap, turned(F.col("ort_inferred"))).otherwise(F.col("ort_inferred")).alias("o"),
        F.when(swap & known, F.col("p_x2y")).otherwise(F.col("p_y2x")).alias("p"), F.when(swap & known, F.col("p_y2x")).otherwise(F.col("p_x2y")).alias("q"), "info_shifted",
    )
    one = F.when(F.col("o") == -2, F.struct((F.col("y") < F.col("x")).alias("on"), (-F.col("lag")).alias("lag"))).otherwise(F.struct((F.col("x") < F.col("y")).alias("on"), F.col("lag").alias("lag")))
    back = F.when((F.col("o") == 6) & (F.col("lag") != 0), F.array(F.struct((F.col("y") < F.col("x")).alias("on"), (-F.col("lag")).alias("lag"))))
    down = F.col("x") > F.col("y")
    rows = flat.select(
        "x", "y", "lag", "o", "p", "q", "info_shifted", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.concat(F.array(one), F.coalesce(back, F.array().cast("array<struct<on:boolean,lag:int>>"))).alias("ways"),
        F.when(down, turned(F.col("o"))).otherwise(F.col("o")).alias("o1"), F.when(known_both(down), F.col("q")).otherwise(F.col("p")).alias("p1"), F.when(known_both(down), F.col("p")).otherwise(F.col("q")).alias("q1"),
    )
    whole = F.col("p").isNotNull() & F.col("q").isNotNull()
    of = lambda f, c: f(F.when(whole, F.col(c)))
    g = rows.groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("x", "y", "lag", "o", "p", "q")).alias("only"), F.min("o1").alias("low"), F.max("o1").alias("high"), F.max("info_shifted").alias("info_shifted"), F.array_distinct(F.flatten(F.collect_list("ways"))).alias("ways"),
        *(of(f, c).alias(f"{name}_{c}") for c in ("p1", "q1") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))),
    )
    text = lambda a: F.array_join(F.transform(a, lambda w: w.cast("string")), ",")
    lag = lambda keep: F.array_distinct(F.transform(F.filter("ways", keep), lambda w: w["lag"]))
    on, zero, off = lag(lambda w: w["on"] & (w["lag"] != 0)), lag(lambda w: w["lag"] == 0), lag(lambda w: ~w["on"] & (w["lag"] != 0))
    parts = F.filter(F.array(text(F.sort_array(on, False)), text(zero), text(F.sort_array(off))), lambda t: t != "")
    lags = F.when((F.size(on) > 0) & (F.size(off) > 0), F.array_join(parts, "/")).otherwise(F.array_join(parts, ","))
    o = F.when((F.col("high") == 6) | ((F.col("low") == -2) & (F.col("high") == 2)), 6).when(F.col("high") == 2, 2).when(F.col("low") == -2, -2).when(F.col("low").isNotNull(), 1)
    p = F.when(o.isin(6, -2), F.col("max_p1")).when(o == 2, F.col("min_p1")).otherwise(F.col("avg_p1"))
    q = F.when(o.isin(6, 2), F.col("max_q1")).when(o == -2, F.col("min_q1")).otherwise(F.col("avg_q1"))
    single = F.col("n") == 1
    pick = lambda alone, many: F.when(single, alone).otherwise(many)
    return g.select(
        pick(F.col("only.x"), F.col("u")).alias("x"), pick(F.col("only.y"), F.col("v")).alias("y"), pick(F.col("only.lag").cast("string"), lags).alias("lags"), pick(F.col("only.o"), o).alias("ort_inferred"),
        pick(F.col("only.p"), p).alias("p_y2x"), pick(F.col("only.q"), q).alias("p_x2y"), "info_shifted",
    )


def known_both(where: Column) -> Column:
    return where & F.col("p").isNotNull() & F.col("q").isNotNull()


def lagged_pairs(pairs: DataFrame, contextual: Sequence[str] = (), x: str = "var1", y: str = "var2", lag: str = "lag") -> DataFrame:
    """(x, y) of (x, y, lag): the first at its lag, the second at lag 0; contextual variables only exist at lag 0."""
    still = F.col(x).isin(*contextual) if contextual else F.lit(False)
    old = F.when(still, F.lit(0)).otherwise(F.col(lag).cast("int"))
    name = lambda v, k: F.concat(F.col(v), F.lit("_lag"), k.cast("string"))
    return pairs.select(name(x, old).alias(x), name(y, F.lit(0)).alias(y)).where(F.col(x).isNotNull() & (F.col(x) != F.col(y))).distinct()


def starting_edges(pairs: DataFrame, contextual: Sequence[str] = ()) -> DataFrame:
    """Pairs that touch layer 0; contextual variables only with layer 0."""
    e = lagged_edges(pairs)
    ctx = lambda v, l: F.col(v).isin(*contextual) if contextual else F.lit(False)
    touch = (F.coalesce("xl", F.lit(0)) == 0) | (F.coalesce("yl", F.lit(0)) == 0)
    fair = (~ctx("xv", "xl") | (F.coalesce("yl", F.lit(0)) == 0)) & (~ctx("yv", "yl") | (F.coalesce("xl", F.lit(0)) == 0))
    return e.where(touch & fair).select(*pairs.columns)

"""Reconstruction of stationary time series: lag the table, reconstruct, orient by time."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.operators import temporal
from causalnet.operators.network import Result, reconstruct
from causalnet.sources.observations import CONTINUOUS_FROM, Variable, first_names, numeric_columns, profile


def lagged_variables(df: DataFrame, lagged: DataFrame, values: Sequence[str], contextual: Sequence[str] = ()) -> list[Variable]:
    """Metadata of lagged columns: the type is that of the variable, checked anew on what lagging has left."""
    kinds = {r["variable"]: r["is_continuous"] for r in profile(df, list(values)).collect()}
    left = {r["variable"]: r for r in profile(lagged).collect()}
    if empty := [c for c in lagged.columns if left[c]["n_known"] == 0]:
        warnings.warn(f"without known values after lagging: {first_names(empty)}", stacklevel=3)
    if constant := [c for c in lagged.columns if left[c]["n_distinct"] == 1]:
        warnings.warn(f"constant after lagging: {first_names(constant)}", stacklevel=3)
    base = lambda c: c.rpartition("_lag")[0]
    return [Variable(c, kinds[base(c)] and left[c]["n_distinct"] >= CONTINUOUS_FROM, contextual=base(c) in contextual) for c in lagged.columns]


def known_pairs(pairs: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """Pairs both of whose names are lagged columns; a warning names the others."""
    one = F.explode(F.array("var1", "var2")).alias("v")
    if absent := [r["v"] for r in pairs.select(one).where(~F.col("v").isin(*names)).distinct().orderBy("v").collect()]:
        warnings.warn(f"{what}: not among the lagged variables, their rows are ignored: {first_names(absent)}", stacklevel=3)
    return pairs.where(F.col("var1").isin(*names) & F.col("var2").isin(*names))


def reconstruct_series(df: DataFrame, by: Sequence[str], time: str, values: Sequence[str], n_layers: int | None = None, delta_t: int | None = None, mov_avg: dict[str, int] | None = None, contextual: Sequence[str] = (), max_nodes: int = 50, keep_max_data: bool = False, black_box: Iterable[tuple[str, str, int | None]] = (), true_edges: DataFrame | None = None, **options) -> Result:
    """Edges between lagged variables; every edge touches the present layer, and times orient the rest.

    ``black_box`` has triples, and ``true_edges`` three columns: a variable, one that follows it, and the lag
    between them (null for a contextual first variable)."""
    if mov_avg:
        df = temporal.moving_average(df, by, time, mov_avg, keep_max_data)
    if n_layers is None or delta_t is None:
        numbers = [v for v in values if v in set(numeric_columns(df)) and v not in contextual]
        r = temporal.estimate_dynamic(df, by, time, numbers, max_nodes, len(contextual), n_lagged=len(values) - len(contextual), n_layers=n_layers, delta_t=delta_t).collect()[0]
        n_layers, delta_t = r["n_layers"], r["delta_t"]
    lagged = temporal.lag_table(df, by, time, {v: (n_layers, delta_t) for v in values}, contextual, keep_max_data).drop(*by, time)
    age = {c: int(c.rpartition("_lag")[2]) for c in lagged.columns if c.rpartition("_lag")[0] not in contextual}
    if delta_t > 1 and "n_eff" not in options:
        options["n_eff"] = int(lagged.count() / delta_t)
    found = lagged_variables(df, lagged, values, contextual)
    black = list(black_box)
    if any(len(b) != 3 for b in black):
        raise ValueError("a pair of the black box of a time series needs its lag: (var1, var2, lag)")
    listed = temporal.lagged_pairs(df.sparkSession.createDataFrame(black, "var1 string, var2 string, lag int"), contextual) if black else None
    black = [tuple(r) for r in known_pairs(listed, lagged.columns, "black box").collect()] if black else []  # the caller's own list
    if true_edges is not None:
        true_edges = known_pairs(temporal.lagged_pairs(true_edges.toDF("var1", "var2", "lag"), contextual), lagged.columns, "true edges")
    out = reconstruct(lagged, found, black, true_edges, age, **({"mode": "TS"} | options))
    out.stationarity = temporal.repeat_over_history(out.edges.where("connected").select("x", "y", F.col("info_shifted")), n_layers, delta_t)
    return out

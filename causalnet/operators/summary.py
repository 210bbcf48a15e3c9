"""The edge summary: signs, partial correlations, genuine causes, consensus, comparison with a truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.operators.encode import running
from causalnet.operators.graph import consensus_orientation, edge_statistics
from causalnet.sources.observations import Options, Variable, numeric_columns


def ranks(df: DataFrame, columns: Sequence[str], equal: str | None = None) -> DataFrame:
    """Average ranks of each column's values: from one row per distinct value, joined back. A row stands for as many as its ``equal`` says, a column that stays."""
    kept = [*columns, *([equal] if equal else [])]
    out = df.select(*kept)
    rows = F.sum(equal) if equal else F.count(F.lit(1))
    sizes = df.agg(*(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns))).collect()[0]
    for i, c in enumerate(columns):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v_")).agg(rows.alias("n_"))
        table = running(counts, "v_", {"upto_": "n_"}, rows=sizes[f"d{i}"]).select("v_", (F.col("upto_") - (F.col("n_") - 1) / 2).alias("r_"))
        out = out.join(table, F.col(c) == F.col("v_"), "left").withColumn(c, F.col("r_")).drop("v_", "r_")
    return out.select(*kept)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho and its sign, over rows that know both."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ranks(d, [x, y]).agg(F.corr(x, y).alias("rho")).withColumn("sign", F.when(F.col("rho") >= 0, "+").otherwise("-"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], equal: str | None = None) -> np.ndarray:
    """Of the ranks over complete rows: d(d+1)/2 aggregates in one pass. With ``equal`` rows are counted; their mean rank is known."""
    whole = df.dropna(subset=list(columns))
    r = ranks(whole, columns, equal)
    d = len(columns)
    of = F.corr
    if equal:
        middle = ((whole.agg(F.sum(equal)).collect()[0][0] or 0) + 1) / 2
        sums = lambda a, b: F.sum(F.col(equal) * (F.col(a) - middle) * (F.col(b) - middle))
        of = lambda a, b: F.when((sums(a, a) > 0) & (sums(b, b) > 0), sums(a, b) / F.sqrt(sums(a, a)) / F.sqrt(sums(b, b)))
    row = r.agg(*(of(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1, d))).collect()[0]
    m = np.eye(d)
    for i in range(d):
        for j in range(i + 1, d):
            m[i, j] = m[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else 0.0
    return m


def partial_spearman(df: DataFrame, x: str, y: str, given: Sequence[str] = (), equal: str | None = None) -> float:
    return partial_of(correlation_matrix(df, [x, y, *given], equal))


def partial_of(m: np.ndarray) -> float:
    """The correlation of the first two variables given the others, from all their correlations."""
    if len(m) == 2:
        return float(m[0, 1])
    p = np.linalg.pinv(m)
    scale = np.sqrt(p[0, 0] * p[1, 1])
    return float(-p[0, 1] / scale) if scale > 0 else 0.0


def partial_correlations(df: DataFrame, edges: Sequence[tuple[str, ...]], equal: str | None = None) -> dict[tuple[str, ...], float]:
    """Of each (x, y, conditions...). Columns without gaps share one matrix; an edge with a gap somewhere has its own complete rows."""
    names = sorted({c for e in edges for c in e})
    if not names:
        return {}
    gaps = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(names))).collect()[0]
    full = [c for i, c in enumerate(names) if gaps[f"g{i}"] == 0]
    at = {c: i for i, c in enumerate(full)}
    m = correlation_matrix(df, full, equal) if any(set(e) <= at.keys() for e in edges) else None
    pick = lambda e: [at[c] for c in e]
    return {e: partial_of(m[np.ix_(pick(e), pick(e))]) if set(e) <= at.keys() else partial_spearman(df, e[0], e[1], e[2:], equal) for e in edges}


def as_numbers(df: DataFrame, found: Sequence[Variable]) -> tuple[DataFrame, set[str]]:
    """Columns that have an order, as numbers: numeric ones, and those with ordered levels."""
    numbers, out = set(numeric_columns(df)), df
    for v in found:
        if v.levels:
            at = F.array_position(F.lit(list(v.levels)), F.col(v.name).cast("string"))
            out = out.withColumn(v.name, F.when(at > 0, at.cast("double")))
            numbers.add(v.name)
    return out, numbers


SUMMARY = (
    "x string, y string, type string, ai string, raw_contributions string, contributions string, info double, n_xy double, info_cond double, cplx double, n_xy_ai double, info_shifted double, "
    "ort_inferred int, ort_ground_truth int, is_inference_correct boolean, is_causal boolean, ort_consensus int, is_causal_consensus boolean, edge_stats string, sign string, "
    "partial_correlation double, p_y2x double, p_x2y double, confidence double"
)


def summarise(df: DataFrame, edges: DataFrame, found: Sequence[Variable], o: Options, history: DataFrame | None = None, truth: DataFrame | None = None, equal: str | None = None) -> DataFrame:
    """A row for each kept edge, for each removed one that has contributors, and for each true one; strongest first.

    ``truth`` has an edge a row, from its first to its second column. Over a cycle of several graphs the
    probabilities are averages, and the consensus follows from them; of one graph there is no consensus. A row of ``df`` stands
    for as many as its column ``equal`` says, if there is one."""
    real = {}
    for r in truth.collect() if truth is not None else ():
        real[r[0], r[1]], real[r[1], r[0]] = 2, -2
    wanted = F.col("connected") | (F.size("ai") > 0)
    if real:
        pairs = df.sparkSession.createDataFrame(sorted({tuple(sorted(p)) for p in real}), "x string, y string")
        rows = edges.where(wanted).unionByName(edges.where(~wanted).join(F.broadcast(pairs), ["x", "y"], "left_semi").select(*edges.columns))
    else:
        rows = edges.where(wanted)
    rows = rows.collect()  # bounded by the number of pairs
    data, numbers = as_numbers(df, found)
    stats = {}
    if history is not None and o.consistent != "no" and history.agg(F.max("iteration")).collect()[0][0]:
        average = history.groupBy("x", "y").agg(F.avg("p_y2x").alias("p_y2x"), F.avg("p_x2y").alias("p_x2y"))
        both = consensus_orientation(edge_statistics(history, o.consensus_threshold).join(average, ["x", "y"]), o.ort_consensus_ratio)
        stats = {(r["x"], r["y"]): r for r in both.collect()}
    deducible = o.latent != "no" and not o.propagation
    partials = partial_correlations(data, [(r["x"], r["y"], *r["ai"]) for r in rows if r["connected"] and {r["x"], r["y"], *r["ai"]} <= numbers], equal)
    out = []

    def ratio(a: float, b: float) -> float:
        return a / b if b > 0 else float("inf")

    for r in rows:
        x, y, ai, code = r["x"], r["y"], list(r["ai"]), r["ort_inferred"]
        kind = "P" if r["connected"] else "N"
        if truth is not None:
            kind = {("P", True): "TP", ("P", False): "FP", ("N", True): "FN", ("N", False): "TN"}[(kind, (x, y) in real)]
        right = real.get((x, y), 0) if truth is not None else None
        s = stats.get((x, y))
        p, q = (s["p_x2y"], s["p_y2x"]) if s else (r["p_x2y"], r["p_y2x"])
        consensus = sure = causal = None
        if s:
            consensus = s["ort_consensus"] if s["connected"] else 0
            if deducible:
                sure = s["is_causal_consensus"] if s["connected"] else None
                causal = bool(sure) and code == consensus if code else None
        elif deducible and code:
            head, tail = (p, q) if code == 2 else (q, p)
            causal = code in (2, -2) and ratio(1 - head, head) < o.ort_consensus_ratio and ratio(tail, 1 - tail) < o.ort_consensus_ratio
        partial = partials.get((x, y, *ai)) if r["connected"] else None
        sign = None if partial is None else "+" if partial >= 0 else "-"
        csv = lambda a: ",".join(a) or None
        raw, shares = ([f"{c:.6f}" for c in r[name] or []] for name in ("raw_contributions", "contributions"))
        out.append((x, y, kind, csv(ai), csv(raw), csv(shares), r["info"], r["n"], r["info_cond"], r["cplx_cond"], r["n_cond"], r["info_shifted"], code, right, None if right is None else code == right, causal, consensus, sure, s["edge_stats"] if s else None, sign, partial, q, p, r["confidence"]))
    out.sort(key=lambda t: (-t[11], t[0], t[1]))
    return df.sparkSession.createDataFrame(out, SUMMARY)

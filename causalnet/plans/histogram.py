"""Cuts of the minimum-description-length histogram of any number of distinct values, in ranges of them.

The least cost of k bins up to a value is a minimum over where the last bin begins. A bin of n rows and length l costs n log(l / n),
which is the least of t l - n (log t + 1) over all densities t. So what a begin adds up to is a curve in t that does not depend on
where the bin ends, and a begin whose curve is nowhere the lowest of a range is never chosen by a later range: of thousands of
begins some dozens are left. All others are dropped with proof, so cuts are those of the plain programme.

One job finds the best last begin of all values for one more bin; a task holds ranges of about ``RANGE`` values.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.functions.kernel import log_c_array

#: Distinct values of a range at least, and most ranges.
RANGE = 1 << 13
RANGES = 256
#: Values that meet all begins among themselves.
BLOCK = 256

STATE = "part int, ends array<double>, below array<double>, score array<double>, back array<long>, member array<boolean>, kept array<long>"


def lowest(score: np.ndarray, ends: np.ndarray, below: np.ndarray, low: float, high: float) -> np.ndarray:
    """Places, rising, of all curves score - t ends + below log t that are the lowest for some t from ``low`` to ``high``; a few
    others may be among them, but none that ties is left out."""
    found, todo = np.zeros(len(score), bool), [(low, high, np.flatnonzero(np.isfinite(score)), 0)]
    while todo:
        a, b, at, stuck = todo.pop()
        middle, former = math.sqrt(a * b), len(at)
        for t in (middle, a, b):
            if len(at) < 2:
                break
            s, e, k = score[at], ends[at], below[at]
            r = int(np.argmin(s - t * e + k * math.log(t)))
            s, e, k = s - s[r], e - e[r], k - k[r]
            least = np.minimum(s - a * e + k * math.log(a), s - b * e + k * math.log(b))
            turn = np.where(k < 0, k / np.where(e < 0, e, -1.0), a)  # convex where it lies before the other
            turn = np.clip(turn, a, b)
            least = np.minimum(least, s - turn * e + k * np.log(turn))
            size = np.abs(s) + b * np.abs(e) + np.abs(k) * (abs(math.log(a)) + abs(math.log(b)) + 1)
            at = at[least <= 1e-6 + 1e-11 * size]
        stuck = stuck + 1 if len(at) > 0.9 * former else 0
        if len(at) <= 8 or b / a < 1 + 1e-6 or (stuck > 3 and b / a < 1.01):  # what halving does not tell apart all but ties
            found[at] = True
        else:
            todo += [(a, middle, at, stuck), (middle, b, at, stuck)]
    return np.flatnonzero(found)


def histogram(values: DataFrame, max_bins: int = 20, epsilon: float = 1e-3, span: int = RANGE, block: int = BLOCK) -> list[float]:
    """Cut points of (v, w), the distinct values and their rows; ``functions.kernel.histogram_cuts`` in ranges. ``values`` should be persisted."""
    one = values.agg(F.count(F.lit(1)).alias("d"), F.sum("w").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()[0]
    d, n, first, last = one["d"], one["n"], one["a"], one["b"]
    ranges = max(1, min(RANGES, -(-d // span)))
    edges = np.unique(values.agg(F.percentile_approx("v", F.lit([i / ranges for i in range(1, ranges)]), 100 * ranges)).collect()[0][0]).tolist() if ranges > 1 else []
    part = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("v"))) if edges else F.lit(0)
    dealt = values.select("v", "w", part.cast("int").alias("part"))
    sums = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.count(F.lit(1)), F.sum("w"), F.min("v"), F.max("v")).collect())
    start, number, rows = {}, [], 0.0  # of each range: rows below it, the last value before and the first after it
    for i, (p, count, w, _, _) in enumerate(sums):
        start[p] = (rows, sums[i - 1][4] if i else None, sums[i + 1][3] if i + 1 < len(sums) else None)
        number.append(number[-1] + sums[i - 1][1] if i else 0)
        rows += w
    at_of = {s[0]: k for s, k in zip(sums, number)}
    begin = first - epsilon

    def cost(e0, k0, e1, k1) -> np.ndarray:
        k = k1 - k0
        return np.where(k > 0, -k * (np.log(np.maximum(k, 1e-300) * epsilon) - np.log(n * (e1 - e0))), 0.0)

    shift = 1 - math.log(n / epsilon)

    def reach(pdf) -> Iterator:
        """(ends, below) of a range, the end before its first value too."""
        p = int(pdf["part"].iloc[0])
        v, w = (pdf.sort_values("v")[c].to_numpy() for c in ("v", "w"))
        before, left, right = start[p]
        edge = begin if left is None else (left + v[0]) / 2
        return p, edge, np.append((v[:-1] + v[1:]) / 2, last + epsilon if right is None else (v[-1] + right) / 2), before + np.cumsum(w), w

    def densities(pdf):
        import pandas as pd

        _, edge, ends, _, w = reach(pdf)
        t = w / np.diff(ends, prepend=edge)
        return pd.DataFrame({"low": [t.min()], "high": [t.max()]})

    # a bin's density lies between those of its values
    bounds = dealt.groupBy("part").applyInPandas(densities, "low double, high double").agg(F.min("low"), F.max("high")).collect()[0]
    low, high = bounds[0] * (1 - 1e-9), bounds[1] * (1 + 1e-9)

    def state(p: int, ends: np.ndarray, below: np.ndarray, score: np.ndarray, back: np.ndarray):
        import pandas as pd

        curve, member = score + shift * below, np.zeros(len(ends), bool)
        for i in range(0, len(ends), block):
            member[i + lowest(curve[i : i + block], ends[i : i + block], below[i : i + block], low, high)] = True
        at = np.flatnonzero(member)
        kept = at[lowest(curve[at], ends[at], below[at], low, high)]
        return pd.DataFrame({"part": [p], "ends": [ends], "below": [below], "score": [score], "back": [back], "member": [member], "kept": [kept]})

    def begun(pdf):
        p, _, ends, below, _ = reach(pdf)
        return state(p, ends, below, cost(begin, 0.0, ends, below), np.zeros(len(ends), np.int64))

    def one_more(k: int, before: dict[int, tuple], extra: float):
        """The states with one more bin; ``before`` has what is left of the begins before each range."""

        def run(frames):
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    p, own = int(row.part), at_of[int(row.part)]
                    ends, below, score, member = (np.asarray(c) for c in (row.ends, row.below, row.score, row.member))
                    new, back = np.full(len(ends), np.inf), np.zeros(len(ends), np.int64)
                    past = before[p]
                    for i in range(0, len(ends), block):
                        here = np.arange(i, min(i + block, len(ends)))
                        at = np.append(np.flatnonzero(member[:i]), here)
                        number, s, e, b = (np.append(q, r) for q, r in zip(past, (own + at + 1, score[at], ends[at], below[at])))
                        with np.errstate(divide="ignore", invalid="ignore"):
                            total = s[None, :] + cost(e[None, :], b[None, :], ends[here, None], below[here, None])
                        total[number[None, :] >= (own + here + 1)[:, None]] = np.inf
                        j = np.argmin(total, axis=1)
                        new[here], back[here] = total[np.arange(len(here)), j] + extra, number[j]
                    back[~np.isfinite(new)] = 0
                    yield state(p, ends, below, new, back)

        return run

    def begins(df: DataFrame) -> tuple[dict[int, tuple], float]:
        """({range: (numbers, scores, ends, rows below) of the begins before it that are left}, the score of the whole)."""
        pick = lambda c: F.transform("kept", lambda i: F.get(c, i.cast("int"))).alias(c)
        found = {r["part"]: r for r in df.select("part", "kept", pick("score"), pick("ends"), pick("below"), F.element_at("score", -1).alias("whole")).collect()}
        out, past = {}, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))
        for p, *_ in sums:
            out[p] = past
            r = found[p]
            past = tuple(np.append(a, b) for a, b in zip(past, (np.asarray(r["kept"], np.int64) + at_of[p] + 1, np.asarray(r["score"], float), np.asarray(r["ends"], float), np.asarray(r["below"], float))))
            at = lowest(past[1] + shift * past[3], past[2], past[3], low, high)
            past = tuple(a[at] for a in past)
        return out, found[sums[-1][0]]["whole"]

    states = [_cut(dealt.groupBy("part").applyInPandas(begun, STATE).repartition(len(sums), "part"))]
    before, whole = begins(states[0])
    best, rounded = (whole, 1), np.array([int(round(n))])
    for k in range(2, min(max_bins, d) + 1):
        extra = log_c_array(rounded, k)[0] - log_c_array(rounded, k - 1)[0] + math.log((d - k + 1) / (k - 1)) if d - k + 1 > 0 else math.inf
        states.append(_cut(states[-1].mapInPandas(one_more(k, before, extra), STATE)))
        before, whole = begins(states[-1])
        if whole < best[0] - 1e-12:
            best = (whole, k)
    cuts, b = [last + epsilon], d
    for k in range(best[1], 1, -1):
        b = _of(states[k - 1], "back", b, number, sums)
        cuts.append(_of(states[k - 1], "ends", b, number, sums))
    return [begin, *reversed(cuts)]


def _cut(df: DataFrame) -> DataFrame:
    """The rows without the plan that led to them: a plan of nested caches takes twice as long to read for each."""
    held = df.persist()
    try:
        return held.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else held.localCheckpoint()
    finally:
        held.unpersist()


def _of(df: DataFrame, column: str, b: int, number: list[int], sums: list[tuple]):
    """What a column has for the value that is number ``b`` of all."""
    i = bisect.bisect_right(number, b - 1) - 1
    return df.where(F.col("part") == sums[i][0]).select(F.element_at(column, b - number[i])).collect()[0][0]

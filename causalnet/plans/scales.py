"""Exact places of continuous variables: where any search may cut them, found by sums over ranges of their values.

A search cuts a variable between groups of neighbouring values, or between equal-frequency bins at its start. Both are
known once every distinct value has its rank among the distinct values and the number of rows below it. Rows are
counted by value first; values are dealt to ranges of about ``RANGE`` of them, a task sums within one, and a few numbers per
range are summed between. What reaches the driver is one row per place, and there are at most some hundred places
however many values there are; nothing is merged that a search could tell apart.

A variable has a scale for each set of other columns that must be known too, since these decide which rows count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.functions.kernel import MOST_BINS_AT_FIRST, Scale

#: Distinct values that one task orders.
RANGE = 1 << 20
GROUP = 1  # bit of a new group; bits 2 and on are those of a new bin among so many


@dataclass
class Places:
    """Runs of neighbouring values: the first of each, the last before it, and what begins there."""

    levels: int
    rows: int
    first: np.ndarray
    before: np.ndarray
    begins: np.ndarray

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[1:], values, side="right")

    def _steps(self, bit: int) -> np.ndarray:
        return np.cumsum(self.begins >> bit & 1)

    def scale(self) -> Scale:
        if self.levels < 3:  # discrete on these rows
            return Scale(self.levels)
        return Scale(self.levels, self._steps(GROUP), self._steps)

    def middle(self, place: int) -> float:
        """Half way between the last value of a place and the first of the next."""
        return float(self.before[place + 1] + self.first[place + 1]) / 2


def tally(rows: DataFrame, wanted: Sequence[tuple[str, Sequence[str]]], weight: str | None = None) -> DataFrame:
    """(key, value, n): the rows of each value of each (column, other columns that must be known), by its place in the list."""
    wanted = list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = {c: b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in {c for v, o in wanted for c in (v, *o)}}
            counts = np.ones(len(b), bool) if weight is None else b.column(weight).fill_null(0.0).to_numpy(zero_copy_only=False) > 0
            for key, (v, others) in enumerate(wanted):
                at = known[v] & counts
                for c in others:
                    at = at & known[c]
                values, n = np.unique(b.column(v).to_numpy(zero_copy_only=False)[at].astype(float), return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key), pa.int32()), pa.array(values), pa.array(n, pa.int64())], ["key", "value", "n"])

    columns = sorted({c for v, o in wanted for c in (v, *o)} | ({weight} if weight else set()))
    return rows.select(*columns).mapInArrow(run, "key int, value double, n long").groupBy("key", "value").agg(F.sum("n").alias("n"))


def _steps(values: int, rows: int, bins: int) -> tuple[int, int]:
    """(rows between cuts, bins) of equal frequency."""
    bins = min(bins, values)
    return (rows // bins, bins) if rows // bins else (1, rows)


def places(tallies: DataFrame, keys: int, maxbins: int, span: int = RANGE) -> list[Places | None]:
    """Places of each key of (key, value, n); None where a key has no rows."""
    tallies = tallies.persist()
    try:
        total = {r["key"]: (r["d"], r["n"]) for r in tallies.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()}
        cuts = {}
        if any(d > span for d, _ in total.values()):
            most = max(-(-d // span) for d, _ in total.values())
            share = F.lit([i / most for i in range(1, most)])
            big = [k for k, (d, _) in total.items() if d > span]
            found = tallies.where(F.col("key").isin(big)).groupBy("key").agg(F.percentile_approx("value", share, 10_000).alias("e"))
            cuts = {r["key"]: np.unique(r["e"]) for r in found.collect()}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, value = b.column("key").to_numpy(), b.column("value").to_numpy()
                part = np.zeros(len(key), np.int32)
                for k, edges in cuts.items():
                    part[key == k] = np.searchsorted(edges, value[key == k], side="right")
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(part), b.column("value"), b.column("n")], ["key", "part", "value", "n"])

        dealt = tallies.mapInArrow(deal, "key int, part int, value double, n long") if cuts else tallies.select("key", F.lit(0).alias("part"), "value", "n")
        zero = [0] * (MOST_BINS_AT_FIRST + 1)
        start = {(k, 0): (0, 0, 0.0, zero) for k in total}  # of each range: values and rows below it, the last value below, the least lag of each start
        if cuts:
            dealt = dealt.persist()
            sums = sorted(tuple(r) for r in dealt.groupBy("key", "part").agg(F.count(F.lit(1)), F.sum("n"), F.max("value")).collect())
            for i, (k, part, _, _, _) in enumerate(sums):
                if i and sums[i - 1][0] == k:
                    d, n, _, lag = start[k, sums[i - 1][1]]
                    start[k, part] = (d + sums[i - 1][2], n + sums[i - 1][3], sums[i - 1][4], lag)
                else:
                    start[k, part] = (0, 0, 0.0, zero)

        def lags(k: int, d: int, n: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """For each number of bins: the cuts before each value less its rank."""
            below, rank = n + np.cumsum(rows) - rows, d + np.arange(len(rows))
            for bins in range(2, MOST_BINS_AT_FIRST + 1):
                size, b = _steps(*total[k], bins)
                yield bins, np.minimum(below // size, b - 1) - rank, rank

        def least(key, pdf):
            import pandas as pd

            k, part = int(key[0]), int(key[1])
            rows = pdf.sort_values("value")["n"].to_numpy()
            d, n, _, _ = start[k, part]
            found = zero[:]
            for bins, lag, _ in lags(k, d, n, rows):
                found[bins] = int(lag.min())
            return pd.DataFrame({"key": [k], "part": [part], "lag": [found]})

        if cuts:
            low = {(r["key"], r["part"]): r["lag"] for r in dealt.groupBy("key", "part").applyInPandas(least, "key int, part int, lag array<long>").collect()}
            for i, (k, part, _, _, _) in enumerate(sums):
                if i and sums[i - 1][0] == k:
                    d, n, last, _ = start[k, part]
                    start[k, part] = (d, n, last, [min(a, b) for a, b in zip(start[k, sums[i - 1][1]][3], low[k, sums[i - 1][1]])])

        def begun(key, pdf):
            import pandas as pd

            k, part = int(key[0]), int(key[1])
            pdf = pdf.sort_values("value")
            value, rows = pdf["value"].to_numpy(), pdf["n"].to_numpy()
            d, n, last, carry = start[k, part]
            group = -(-total[k][0] // maxbins)
            rank = d + np.arange(len(value))
            bits = ((rank % group == 0).astype(np.int64)) << GROUP
            for bins, lag, rank in lags(k, d, n, rows):
                now = rank + np.minimum.accumulate(np.minimum(lag, carry[bins]))
                former = np.concatenate([[d - 1 + carry[bins] if d else -1], now[:-1]])
                bits |= (now > former).astype(np.int64) << bins
            if not d:
                bits[0] = 0
            at = np.flatnonzero(bits) if d else np.concatenate([[0], np.flatnonzero(bits)])
            return pd.DataFrame({"key": k, "value": value[at], "before": np.concatenate([[last], value[:-1]])[at], "begins": bits[at]})

        found = dealt.groupBy("key", "part").applyInPandas(begun, "key int, value double, before double, begins long").toPandas()
        out: list[Places | None] = [None] * keys
        for k, p in found.groupby("key"):
            p = p.sort_values("value")
            out[int(k)] = Places(*total[int(k)], p["value"].to_numpy(), p["before"].to_numpy(), p["begins"].to_numpy())
        if cuts:
            dealt.unpersist()
        return out
    finally:
        tallies.unpersist()

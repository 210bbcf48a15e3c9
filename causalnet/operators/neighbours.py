"""Whether gaps fall at random, for continuous variables: divergence of two samples from their neighbours.

The rows that know z are compared with all rows that know x and y. Where x and y are discrete the counts of their levels
say how far the two distributions are apart; where one or both are continuous, the distances of the known points to
their 5th neighbours among the known points and among all do (``K``, the point itself counted):
n1 d mean(ln(r_all / r_known)) + n1 ln((n2 - 1) / (n1 - 1)) in d dimensions. Of a discrete and a continuous variable
every level has a divergence of its own in one dimension, and that of the levels' counts is added.

The search is exact and distributed. Points are dealt to cells of about ``CELL`` points, cut at quantiles of x and, in two
dimensions, at quantiles of y within each strip of x. A task holds one cell and streams points past it. First every
known point meets its own cell, which bounds its distance from above; then it visits the other cells that a square of
this size around it touches, and the least distances of all visits are merged. Many tests share the same few jobs.

Ties are broken by adding a small amount to each coordinate that depends on the values and on the number of the copy
alone, so reruns agree; for very large values it grows with them, so that it isn't rounded away. Points of equal
values are counted before they are dealt.

Rows that lack x, y or a condition are left out; a level or a pair of at most ``K`` known rows has no divergence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.plans.shipping import ship

#: The neighbour whose distance counts, and the most that is added to a coordinate. Fixed values.
K = 5
NOISE = 5e-5
#: Points that a cell holds, about.
CELL = 1000
#: Strips, and cells of a strip, at most; beyond their product cells grow.
MOST_CUTS = 1000
#: Copies of a point that one task makes.
COPIES = 4096


def _moved(c: str, salt: int, parts: Sequence[Column]) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(salt)), *parts)), 1, 8)
    return F.col(c) + (F.conv(digits, 16, 10).cast("double") / F.lit(2.0**31) - 1) * F.greatest(F.lit(NOISE), F.abs(c) * 1e-10)


def separate(points: DataFrame) -> DataFrame:
    """(k, d, x, y, known) with a row per point and no ties, from rows of (k, d, x, y, known) with ties.

    Of equal points the known ones come first; y is 0 in one dimension."""
    text = lambda c: F.col(c).cast("string")
    flat = points.withColumn("y", F.when(F.col("d") > 1, F.col("y")))
    tallies = flat.groupBy("k", "d", "x", "y").agg(F.count(F.lit(1)).alias("q"), F.count_if("known").alias("p"))
    some = tallies.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("q") - 1) / COPIES))))
    many = some.where(F.col("q") > COPIES).repartition("k", "x", "y", "part")
    last = F.least(F.col("q"), (F.col("part") + 1) * COPIES) - 1
    each = some.where(F.col("q") <= COPIES).unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last)))
    own = [text("x"), F.coalesce(text("y"), F.lit("")), text("copy")]
    x, y = _moved("x", 0, own), F.when(F.col("d") > 1, _moved("y", 1, own)).otherwise(0.0)
    return each.select("k", "d", x.alias("x"), y.alias("y"), (F.col("copy") < F.col("p")).alias("known"))


class Grid:
    """Cells of one space of one group of points: edges in x, and for each strip in y."""

    def __init__(self, x: Sequence[float], y: Sequence[Sequence[float]]):
        self.x, self.y = np.asarray(x, float), [np.asarray(e, float) for e in y]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.y])])

    def cell(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.x, x, side="right")
        out = np.empty(len(x), np.int64)
        for s in np.unique(strip):
            at = strip == s
            out[at] = self.first[s] + np.searchsorted(self.y[s], y[at], side="right")
        return out

    def touched(self, x: float, y: float, r: float) -> list[int]:
        """Cells that the square of half side ``r`` around a point touches."""
        a, b = np.searchsorted(self.x, x - r, side="right"), np.searchsorted(self.x, x + r, side="right")
        out = []
        for s in range(a, b + 1):
            low, high = np.searchsorted(self.y[s], y - r, side="right"), np.searchsorted(self.y[s], y + r, side="right")
            out += range(self.first[s] + low, self.first[s] + high + 1)
        return out


def _every(edges: Sequence[float], cuts: int) -> list[float]:
    """``cuts`` of evenly spread quantiles, without repeats."""
    n = len(edges) + 1
    return sorted({edges[round((i + 1) * n / (cuts + 1)) - 1] for i in range(cuts)}) if cuts > 0 and edges else []


def _in_strips(xs: dict[tuple[str, str], list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, space, x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "space", "x"))
            strip = np.zeros(len(k), np.int32)
            for key in set(zip(k.tolist(), space.tolist())):
                at = (k == key[0]) & (space == key[1])
                strip[at] = np.searchsorted(xs[key], x[at], side="right")
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("space"), pa.array(strip), b.column("y")], ["k", "space", "strip", "y"])

    return run


def grids(points: DataFrame, cell: int) -> dict[tuple[str, str], Grid]:
    """Grids of all points ("all") and of the known ones ("known") of each group; a few numbers per cell reach the driver."""
    both = points.select("k", "d", "x", "y", F.explode(F.when(F.col("known"), F.array(F.lit("all"), F.lit("known"))).otherwise(F.array(F.lit("all")))).alias("space"))
    sizes = {(r["k"], r["space"]): (r["n"], r["d"]) for r in both.groupBy("k", "space").agg(F.count(F.lit(1)).alias("n"), F.first("d").alias("d")).collect()}

    def strips(n: int, d: int) -> tuple[int, int]:
        cells = -(-n // cell)
        a = min(MOST_CUTS, cells if d == 1 else math.ceil(math.sqrt(cells)))
        return a, min(MOST_CUTS, -(-cells // a)) if d > 1 else 1

    wanted = {key: strips(*v) for key, v in sizes.items()}
    quantiles = lambda c, n: F.percentile_approx(c, F.lit([i / n for i in range(1, n)]) if n > 1 else F.lit([0.5]), 10_000)
    top = max((a for a, _ in wanted.values()), default=1)
    xs = {key: [] for key in wanted}
    if top > 1:
        for r in both.groupBy("k", "space").agg(quantiles("x", top).alias("e")).collect():
            xs[r["k"], r["space"]] = _every(r["e"], wanted[r["k"], r["space"]][0] - 1)
    ys = {key: [[] for _ in range(len(x) + 1)] for key, x in xs.items()}
    deep = max((b for _, b in wanted.values()), default=1)
    if deep > 1:
        flat = [k for (k, _), (_, b) in wanted.items() if b > 1]
        dealt = both.where("d > 1").where(F.col("k").isin(flat)).select("k", "space", "x", "y").mapInArrow(_in_strips(xs), "k string, space string, strip int, y double")
        for r in dealt.groupBy("k", "space", "strip").agg(quantiles("y", deep).alias("e")).collect():
            ys[r["k"], r["space"]][r["strip"]] = _every(r["e"], wanted[r["k"], r["space"]][1] - 1)
    return {key: Grid(x, ys[key]) for key, x in xs.items()}


ROWS = "k string, space string, cell long, x double, y double, held boolean, near array<double>"


def _dealt(found: dict[tuple[str, str], Grid]):
    """Every point in its cell, to be held there; known ones also as visitors of the same cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "x", "y"))
            known = b.column("known").to_numpy(zero_copy_only=False)
            for g in set(k.tolist()):
                for space in ("all", "known"):
                    grid = found.get((g, space))
                    held = np.flatnonzero((k == g) & (known if space == "known" else True))
                    if grid is None or not len(held):
                        continue
                    at = np.concatenate([held, np.flatnonzero((k == g) & known)])
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * n), pa.array([space] * n), pa.array(grid.cell(x[at], y[at])), pa.array(x[at]), pa.array(y[at]), pa.array(np.arange(n) < len(held)), pa.array([None] * n, pa.list_(pa.float64()))],
                        ["k", "space", "cell", "x", "y", "held", "near"],
                    )

    return run


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, the points that lie in it first: the visitors with their ``K`` least distances to these."""
    at, held, ready = None, [], None
    for whole in batches:
        k, space, cell, own = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("k", "space", "cell", "held"))
        change = np.flatnonzero((k[1:] != k[:-1]) | (space[1:] != space[:-1]) | (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])) + 1
        for s, e in zip([0, *change.tolist()], [*change.tolist(), len(k)]):
            if s == e:
                continue
            if (key := (k[s], space[s], cell[s])) != at:
                at, held, ready = key, [], None
            xy = np.stack([whole.column(c).slice(s, e - s).to_numpy() for c in ("x", "y")], axis=1)
            if own[s]:
                held.append(xy)
                continue
            if ready is None:
                ready = np.concatenate(held) if held else np.zeros((0, 2))
            for a in range(0, e - s, 512):
                part = xy[a : a + 512]
                d = np.sqrt(((part[:, None, :] - ready[None, :, :]) ** 2).sum(axis=2))
                d = np.sort(np.partition(d, K - 1, axis=1)[:, :K] if d.shape[1] > K else d, axis=1)
                b = whole.slice(s + a, len(part))
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("space"), b.column("cell"), b.column("x"), b.column("y"), pa.array(np.zeros(len(part), bool)), pa.array(list(d), pa.list_(pa.float64()))], ["k", "space", "cell", "x", "y", "held", "near"])


def _visits(found: dict[tuple[str, str], Grid]):
    """The other cells that may hold a nearer neighbour than the own one did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, space, cell, x, y, near in zip(*(b.column(c).to_pylist() for c in ("k", "space", "cell", "x", "y", "near"))):
                r = near[K - 1] if len(near) >= K else math.inf
                out += [(k, space, c, x, y) for c in found[k, space].touched(x, y, r) if c != cell]
            if out:
                columns = [pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(out), bool)), pa.array([None] * len(out), pa.list_(pa.float64()))], ["k", "space", "cell", "x", "y", "held", "near"])

    return run


def _met(rows: DataFrame) -> DataFrame:
    keys = ["k", "space", "cell"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("held")).mapInArrow(_nearest, ROWS)


def divergences(points: DataFrame, cell: int = CELL) -> dict[str, tuple[int, int, float | None]]:
    """(n1, n2, n1 times the divergence of the n1 known points from all n2) of each group of points (k, d, x, y, known).

    d is 1 or 2; y counts in two dimensions only. A row per group reaches the driver."""
    ship(points.sparkSession)
    apart = separate(points).persist()
    dealt = first = None
    try:
        found = grids(apart, cell)
        dealt = apart.mapInArrow(_dealt(found), ROWS).persist()
        first = _met(dealt).persist()
        more = _met(dealt.where("held").unionByName(first.mapInArrow(_visits(found), ROWS)))
        near = F.sort_array(F.flatten(F.collect_list("near")))  # of the few cells that a point visits, K each
        radius = first.unionByName(more).groupBy("k", "space", "x", "y").agg(F.get(near, F.lit(K - 1)).alias("r"))
        logs = radius.groupBy("k").agg(F.sum(F.when(F.col("space") == "all", F.log("r")).otherwise(-F.log("r"))).alias("s"))
        sizes = apart.groupBy("k").agg(F.first("d").alias("d"), F.count_if("known").alias("n1"), F.count(F.lit(1)).alias("n2"))
        kl = F.when(F.col("n1") > K, F.col("d") * F.col("s") + F.col("n1") * F.log((F.col("n2") - 1) / (F.col("n1") - 1)))
        return {r["k"]: (r["n1"], r["n2"], r["kl"]) for r in sizes.join(logs, "k", "left").select("k", "n1", "n2", kl.alias("kl")).collect()}
    finally:
        for df in (apart, dealt, first):
            if df is not None:
                df.unpersist()


def missing_at_random(df: DataFrame, tests: Sequence[tuple[str, str, str, Sequence[str]]], continuous: set[str], cell: int = CELL) -> list[tuple[int, int, float]]:
    """(n1, n2, kl) of each test (x, y, z, conditions): of the n2 rows that know x, y and the conditions, n1 know z too; kl is n1 times
    the divergence of (x, y) among these from all. At least one of x and y is continuous."""
    rows = []
    for i, (x, y, z, us) in enumerate(tests):
        numbers = [c for c in (x, y) if c in continuous]
        level = F.lit("") if len(numbers) == 2 else F.col(y if numbers == [x] else x).cast("string")
        a, b = (F.col(c).cast("double") for c in (numbers[0], numbers[-1]))
        known = F.lit(True)
        for c in (x, y, *us):
            known = known & F.col(c).isNotNull()
        rows.append(F.struct(F.concat_ws("|", F.lit(str(i)), level).alias("k"), F.lit(len(numbers)).alias("d"), a.alias("x"), b.alias("y"), F.col(z).isNotNull().alias("known"), known.alias("whole")))
    points = df.select(F.explode(F.array(*rows)).alias("r")).where("r.whole").select("r.*").drop("whole")
    groups: list[list] = [[] for _ in tests]
    for k, v in divergences(points, cell).items():
        groups[int(k.split("|", 1)[0])].append(v)
    out = []
    for (x, y, _, _), found in zip(tests, groups):
        n1, n2 = sum(v[0] for v in found), sum(v[1] for v in found)
        if {x, y} <= continuous:
            kl = sum(v[2] or 0.0 for v in found)
        else:
            kl = sum(max(0.0, v[2] or 0.0) + (v[0] * math.log(v[0] / n1 * n2 / v[1]) if v[0] else 0.0) for v in found)
        out.append((n1, n2, kl))
    return out


def kl_missing_at_random(df: DataFrame, x: str, y: str, z: str, given: Sequence[str] = (), continuous: Sequence[str] = (), cell: int = CELL) -> DataFrame:
    """One row: n, kl, penalty (ln n), rejected; ``continuous`` names which of x and y are."""
    n1, _, kl = missing_at_random(df, [(x, y, z, given)], set(continuous), cell)[0]
    penalty = math.log(n1) if n1 else 0.0
    return df.sparkSession.createDataFrame([(float(n1), kl, penalty, kl > penalty)], "n double, kl double, penalty double, rejected boolean")

"""Network reconstruction: skeleton, confidence, orientation, summary."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalnet.functions.kernel import joint
from causalnet.operators import graph
from causalnet.operators.orientation import propagate
from causalnet.plans.requests import Engine
from causalnet.plans.rounds import EQUAL
from causalnet.sources.observations import Options, Variable, check_observations, surely_discrete, usable_weights, variables

EDGES = (
    "x string, y string, n double, info double, cplx double, n_cond double, info_cond double, cplx_cond double, info_shifted double, ai array<string>, raw_contributions array<double>, contributions array<double>, "
    "confidence double, connected boolean, p_y2x double, p_x2y double, tip_x int, tip_y int, ort_inferred int"
)

#: Different rows up to which each task of a shuffle knows them all, and row numbers that it takes at a time.
FEW = 1 << 16
STEP = 1 << 19


@dataclass
class Edge:
    x: int
    y: int
    n: float = 0.0
    info: float = 0.0
    cplx: float = 0.0
    n_cond: float = 0.0
    info_cond: float = 0.0
    cplx_cond: float = 0.0
    connected: bool = True
    us: list[int] = field(default_factory=list)
    raw_shares: list[float] = field(default_factory=list)  # of the information without conditions
    shares: list[float] = field(default_factory=list)  # of the information that the former conditions leave
    top: int | None = None
    score: float = 0.0
    confidence: float | None = None
    p: dict = field(default_factory=dict)  # node -> head probability at that node
    tip: dict = field(default_factory=dict)

    @property
    def key(self) -> tuple[int, int]:
        return self.x, self.y

    def shifted(self) -> float:
        return self.info_cond - self.cplx_cond


def split_name(name: str) -> tuple[str, int]:
    """(variable, lag) of a lagged name; lag 0 without a suffix."""
    m = re.fullmatch(r"(.*)_lag([0-9]+)", name, re.DOTALL)
    return (m[1], int(m[2])) if m else (name, 0)


class Waiting(Exception):
    """A needed request is not yet answered; the next batch will have it."""


class Reconstruction:
    """Driver state: a few numbers for each pair of variables."""

    def __init__(self, engine: Engine, options: Options = Options(), black_box: Iterable[tuple[int, int]] = (), age: dict[int, int] | None = None):
        self.engine, self.o, self.age = engine, options, age
        v = engine.variables
        forbidden = {tuple(sorted(p)) for p in black_box}
        self.pairs = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (i, j) not in forbidden and not (v[i].consequence and v[j].consequence) and not (age and min(age.get(i, 0), age.get(j, 0)) > 0)]
        names = [split_name(k.name) for k in v] if options.mode == "TS" else []
        self.kin = [name for name, _ in names]  # of a series, the variable without its lag
        self.lag = [lag for _, lag in names]
        self.at = {place: i for i, place in enumerate(names)}
        self.base: dict[tuple[int, int], Edge] = {}
        self.edges: dict[tuple[int, int], Edge] = {}
        self.triples: list[dict] = []

    def unconditional(self) -> None:
        e = self.engine
        e.run(e.two(*p) for p in self.pairs)
        for p in self.pairs:
            r = e.get(e.two(*p))
            k = Edge(*p, r["n"], r["info"], r["cplx"], r["n"], r["info"], r["cplx"])
            k.connected = k.shifted() > 0
            self.base[p] = k

    def _candidates(self, x: int, y: int, us: Sequence[int], near: dict[int, set[int]], allowed) -> list[int]:
        v = self.engine.variables
        return [
            z
            for z in range(len(v))
            if z not in (x, y) and z not in us and not v[z].consequence and not self._own_past(x, y, z) and (self.o.latent == "yes" or z in near.get(x, ()) or z in near.get(y, ())) and (allowed is None or z in allowed(x, y))
        ]

    def _own_past(self, x: int, y: int, z: int) -> bool:
        """Whether z is the other variable of a pair with a contextual one, at another lag."""
        v = self.engine.variables
        return bool(self.kin) and ((v[x].contextual and self.kin[y] == self.kin[z]) or (v[y].contextual and self.kin[x] == self.kin[z]))

    def repeats(self, x: int, y: int) -> list[tuple[int, int]]:
        """The same edge at earlier times, as far as there are lags; contextual variables have no earlier times."""
        v, out = self.engine.variables, []
        if not self.kin or (v[x].contextual and v[y].contextual):
            return out
        for s in sorted(set(self.lag))[1:]:
            i, j = (n if v[n].contextual else self.at.get((self.kin[n], self.lag[n] + s)) for n in (x, y))
            if i is not None and j is not None:
                out.append((i, j))
        return out

    def _answer(self, request: tuple) -> dict:
        r = self.engine.get(request)
        if r is None:
            self.wanted.append(request)
            raise Waiting
        return r

    def _best(self, e: Edge, us: list[int], near, allowed) -> None:
        """The contributor of highest positive score. Of those that tie, the one that shares most information
        with both ends; then the least position."""
        g, missing, found = self.engine, False, []
        for z in self._candidates(e.x, e.y, us, near, allowed):
            r = g.get(g.three(e.x, e.y, z, us))
            if r is None:
                self.wanted.append(g.three(e.x, e.y, z, us))
                missing = True
            elif r["score"] > 0:
                shared = r["i3"] - r["k3"]
                found.append((r["score"], z, *(shared / v if v else 0.0 for v in (e.info - e.cplx, r["i2"] - r["k2"]))))
        if missing:
            raise Waiting
        most = max((f[0] for f in found), default=0.0)
        found = [f for f in found if f[0] >= most - 1e-12]
        if len(found) > 1:
            ask = [g.tie(e.x, e.y, f[1]) for f in found]
            if unknown := [q for q in ask if g.get(q) is None]:
                self.wanted += unknown
                raise Waiting
            shared = [g.get(q)["shared"] for q in ask]
            found = [f for f, h in zip(found, shared) if h >= max(shared) - 1e-12]
        e.score, e.top, e.raw_share, e.share = found[0] if found else (0.0, None, 0.0, 0.0)

    def skeleton(self, allowed=None) -> None:
        """Remove edges that contributors explain away, the strongest first. The order is sequential;
        every round asks in one batch for all that the open edges may need next, then replays."""
        while True:
            self.wanted: list[tuple] = []
            try:
                self._replay(allowed)
                return
            except Waiting:
                self.engine.run(self.wanted)

    def _replay(self, allowed) -> None:
        g = self.engine
        edges = {p: Edge(e.x, e.y, e.n, e.info, e.cplx, e.n, e.info, e.cplx, e.connected) for p, e in self.base.items()}
        near = graph.neighbours(p for p, e in edges.items() if e.connected)
        waiting = False
        for e in edges.values():
            if e.connected:
                try:
                    self._best(e, [], near, allowed)
                except Waiting:
                    waiting = True
        if waiting:
            raise Waiting
        open_edges = {p for p, e in edges.items() if e.connected and e.top is not None}

        def speculate() -> None:
            for p in open_edges:
                e = edges[p]
                us = [*e.us, e.top]
                self.wanted.append(g.two(e.x, e.y, us))
                self.wanted += [g.three(e.x, e.y, z, us) for z in self._candidates(e.x, e.y, us, near, allowed)]

        while open_edges:
            p = max(sorted(open_edges), key=lambda q: edges[q].score)
            e = edges[p]
            us = [*e.us, e.top]
            try:
                r = self._answer(g.two(e.x, e.y, us))
                removed = r["info"] - r["cplx"] <= 0
                if not removed:
                    trial = Edge(e.x, e.y, e.n, e.info, e.cplx)
                    self._best(trial, us, near, allowed)
            except Waiting:
                speculate()
                raise
            e.us, e.raw_shares, e.shares = us, [*e.raw_shares, e.raw_share], [*e.shares, e.share]
            e.n_cond, e.info_cond, e.cplx_cond = r["n"], r["info"], r["cplx"]
            if removed:
                e.connected = False
                open_edges.discard(p)
                near.get(e.x, set()).discard(e.y)
                near.get(e.y, set()).discard(e.x)
            else:
                e.score, e.top, e.raw_share, e.share = trial.score, trial.top, trial.raw_share, trial.share
                if e.top is None:
                    open_edges.discard(p)
        self.edges = edges

    def confidence(self) -> None:
        """Compare each kept edge with permutations of its first variable, all in one batch."""
        kept = [e for e in self.edges.values() if e.connected]
        if not self.o.n_shuffles or not kept:
            return
        means = permutation_means(self.engine, [e.key for e in kept], self.o.n_shuffles, self.o.seed)
        for e in kept:
            e.confidence = float(np.exp(-e.shifted()) / max(means[e.key], 1e-300))
            if e.confidence > self.o.conf_threshold:
                e.connected = False

    def orient(self) -> None:
        if not self.o.orientation:
            return
        v, g = self.engine.variables, self.engine
        latent = self.o.latent in ("yes", "orientation")
        kept = {p: e for p, e in self.edges.items() if e.connected}
        # With latent variables a series' edges also stand at earlier times, where they make more triples.
        stands = {p: [p, *(self.repeats(*p) if latent else ())] for p in kept}
        joined = {tuple(sorted(q)) for group in stands.values() for q in group}
        near = graph.neighbours(joined)
        triples = [(x, z, y) for z in sorted(near) for x in sorted(near[z]) for y in sorted(near[z]) if x < y and (x, y) not in joined]
        ask = {t: g.three(t[0], t[2], t[1], [u for u in (self.edges.get((t[0], t[2])) or Edge(0, 0)).us if u != t[1]]) for t in triples}
        g.run(ask.values())
        i3 = []
        for t in triples:
            r = g.get(ask[t])
            i3.append(r["i3"] - r["k3"])
        context = [i for i, k in enumerate(v) if k.contextual]
        effects = [i for i, k in enumerate(v) if k.consequence]
        tips = propagate(triples, i3, latent, self.o.propagation, context, effects, self.age)
        for e in kept.values():
            e.p, e.tip = {e.x: 0.5, e.y: 0.5}, {e.x: 1, e.y: 1}
        self.triples = []
        heads: dict[tuple[int, int], float] = {}  # (node, other): the strongest of its triples
        for (x, z, y), v3, (px, pzx, pzy, py) in zip(triples, i3, tips):
            for tip, p in (((x, z), px), ((z, x), pzx), ((z, y), pzy), ((y, z), py)):
                if abs(p - 0.5) > abs(heads.setdefault(tip, 0.5) - 0.5):
                    heads[tip] = p
            call = pzx > 0.5 and pzy > 0.5
            self.triples.append({"x": x, "z": z, "y": y, "i3": v3, "p1": px, "p2": pzx, "p3": pzy, "p4": py, "conflict": (v3 < 0) != call if v3 else False})
        for e in kept.values():
            for i, j in stands[e.key]:  # the strongest of all times
                for node, tip in ((e.x, (i, j)), (e.y, (j, i))):
                    if abs(heads.get(tip, 0.5) - 0.5) > abs(e.p[node] - 0.5):
                        e.p[node] = heads[tip]
            if not any(q in heads for q in stands[e.key]):
                for node, other in ((e.x, e.y), (e.y, e.x)):
                    if v[node].contextual:
                        e.p[node] = 0.0
                    elif v[node].consequence:
                        e.p[node] = 1.0
                    elif self.age and node in self.age and other in self.age and self.age[node] < self.age[other]:
                        e.p[node] = 1.0
                        e.p[other] = 0.0 if not latent else e.p[other]
            for node in (e.x, e.y):
                p = e.p[node]
                e.tip[node] = 2 if p > 0 and (1 - p) / p < self.o.ort_proba_ratio else 1

    def code(self, e: Edge) -> int:
        if not e.connected:
            return 0
        head = (e.tip.get(e.x, 1) == 2, e.tip.get(e.y, 1) == 2)
        return {(False, False): 1, (False, True): 2, (True, False): -2, (True, True): 6}[head]

    def run(self) -> Reconstruction:
        self.unconditional()
        tracker, allowed, self.history = graph.CycleTracker(), None, []
        for _ in range(max(1, self.o.max_iteration)):
            self.skeleton(allowed)
            self.confidence()
            self.orient()
            state = frozenset((p, self.code(e)) for p, e in self.edges.items() if e.connected)
            cycle = tracker.add(state)
            self.history.append({p: (self.code(e), dict(e.p)) for p, e in self.edges.items()})
            if self.o.consistent == "no":
                break
            if cycle is not None:
                self.history = self.history[-len(cycle) - 1 : -1] or self.history[-1:]
                self.undirect({p for p in self.edges if len({h[p][0] for h in self.history}) > 1})
                break
            near = graph.neighbours(p for p, e in self.edges.items() if e.connected)
            into = {(b, a) for e in self.edges.values() if e.connected for a, b in ((e.x, e.y), (e.y, e.x)) if e.tip.get(b, 1) == 2 and e.tip.get(a, 1) != 2}

            def allowed(x, y, near=near, into=into):
                paths = graph.on_paths(near, x, y)
                if self.o.consistent == "skeleton":
                    return paths
                return {z for z in paths if (z in near.get(x, ()) and (z, x) not in into) or (z in near.get(y, ()) and (z, y) not in into)}

        return self

    def undirect(self, changed: set[tuple[int, int]]) -> None:
        """Edges that change within the cycle of graphs are kept without conditions or a direction."""
        for p in changed:
            e = self.edges[p]
            e.connected, e.us, e.raw_shares, e.shares = True, [], [], []
            e.n_cond, e.info_cond, e.cplx_cond = e.n, e.info, e.cplx
            e.p, e.tip = {e.x: 0.5, e.y: 0.5}, {e.x: 1, e.y: 1}

    def edge_table(self) -> DataFrame:
        """All pairs, their names in alphabetic order."""
        v = self.engine.variables
        rows = []
        for e in self.edges.values():
            a, b = sorted((e.x, e.y), key=lambda i: v[i].name)
            p = (e.p.get(a), e.p.get(b)) if e.connected and e.p else (None, None)
            code = self.code(e)
            code = {2: -2, -2: 2}.get(code, code) if a != e.x else code
            rows.append((v[a].name, v[b].name, e.n, e.info, e.cplx, e.n_cond, e.info_cond, e.cplx_cond, e.shifted(), [v[u].name for u in e.us], [float(s) for s in e.raw_shares], [float(s) for s in e.shares], e.confidence, e.connected, *p, e.tip.get(a, 1) if e.connected else 0, e.tip.get(b, 1) if e.connected else 0, code))
        rows.sort(key=lambda r: (not r[13], -r[8], r[0], r[1]))
        return self.engine.spark.createDataFrame(rows, EDGES)

    def triple_table(self) -> DataFrame:
        n = [k.name for k in self.engine.variables]
        rows = [(n[t["x"]], t["p1"], t["p2"], n[t["z"]], t["p3"], t["p4"], n[t["y"]], t["i3"], t["conflict"]) for t in self.triples]
        return self.engine.spark.createDataFrame(rows, "source1 string, p1 double, p2 double, target string, p3 double, p4 double, source2 string, ni3 double, conflict boolean")

    def history_table(self) -> DataFrame:
        """Every pair in every iteration of the cycle, its names in alphabetic order."""
        n = [k.name for k in self.engine.variables]
        rows = []
        for i, h in enumerate(self.history):
            for (x, y), (code, p) in h.items():
                a, b = sorted((x, y), key=lambda k: n[k])
                rows.append((n[a], n[b], i, code if a == x else {2: -2, -2: 2}.get(code, code), p.get(a), p.get(b)))
        return self.engine.spark.createDataFrame(rows, "x string, y string, iteration int, adj int, p_y2x double, p_x2y double")


def permutation_means(engine: Engine, pairs: Sequence[tuple[int, int]], n_shuffles: int, seed: int = 42, few: int = FEW, step: int = STEP) -> dict[tuple[int, int], float]:
    """Mean exp(-I') over shuffles of x. Rows have dense numbers that follow from their values alone, and a keyed bijection of
    these numbers is a shuffle; one serves all pairs. The weight stays with y.

    Of discrete variables with at most ``few`` different rows, a task that knows where each of these begins tells both rows from
    a number and where it goes. Otherwise the moved rows meet those that stay in a join; both count the same."""
    sums = dict.fromkeys(pairs, 0.0)
    first, groups, different = ordered(engine.rows)
    xs, ys = sorted({x for x, _ in pairs}), sorted({y for _, y in pairs})
    rows = None
    try:
        if engine.equal and different <= few:
            table = first.select("first_", *(f"v{i}" for i in sorted({*xs, *ys}))).toArrow().sort_by("first_")
            blocks = -(-engine.n // step)
            numbers = engine.spark.range(0, blocks, 1, blocks)
            shuffle = lambda pairs, key: engine.moved(numbers, pairs, _matched(table, xs, ys, engine.n, key, step))
        else:
            rows = spread(first).persist()

            def shuffle(pairs, key):
                left = rows.select("at_", *(F.col(f"v{x}").alias(f"x{x}") for x in xs)).mapInArrow(_shuffled(engine.n, key), "at_ long, " + ", ".join(f"x{x} {dict(rows.dtypes)[f'v{x}']}" for x in xs))
                moved = rows.join(left, "at_").drop("at_").persist()
                try:
                    return engine.moved(moved, pairs)
                finally:
                    moved.unpersist()

        for s in range(n_shuffles):
            found = shuffle([(f"x{x}", f"v{y}") for x, y in pairs], seed + 1 + s)
            for k, p in enumerate(pairs):
                sums[p] += float(np.exp(-max(found[k], 0.0)))
    finally:
        if rows is not None:
            rows.unpersist()
        groups.unpersist()
    return {p: v / n_shuffles for p, v in sums.items()}


def numbered(rows: DataFrame, span: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(numbered, groups): ``rows`` with at_ = 0, 1, ... in the order of a hash of all columns, then of the columns themselves.

    Equal rows are interchangeable, so the numbers don't depend on partitions or on what is computed again. A task orders
    one of equal parts of the hashes' range, of about ``span`` different rows; one sum for each is carried over. ``groups`` is persisted; the caller lets it go."""
    first, groups, _ = ordered(rows, span)
    return spread(first), groups


def ordered(rows: DataFrame, span: int = 1 << 20) -> tuple[DataFrame, DataFrame, int]:
    """(a row for each different one of ``rows``, with n_ equal ones and first_, the number of their first; groups as in ``numbered``; how many
    are different). Where ``rows`` have n_, each stands for as many."""
    columns = [c for c in rows.columns if c != EQUAL]
    n = F.sum(EQUAL) if EQUAL in rows.columns else F.count(F.lit(1))
    groups = rows.groupBy(*columns).agg(n.alias("n_")).withColumn("h_", F.xxhash64(*columns)).persist()
    different = groups.count()
    bits = max(0, math.ceil(math.log2(max(1, different / span))))
    parts = groups.withColumn("part_", F.shiftright("h_", 64 - bits) if bits else F.lit(0).cast("long"))
    before, total = [], 0
    for r in parts.groupBy("part_").agg(F.sum("n_").alias("n")).orderBy("part_").collect():
        before.append((r["part_"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "part_ long, before_ long")
    upto = F.sum("n_").over(Window.partitionBy("part_").orderBy("h_", *columns).rowsBetween(Window.unboundedPreceding, 0))
    first = parts.withColumn("upto_", upto).join(F.broadcast(offsets), "part_").withColumn("first_", F.col("before_") + F.col("upto_") - F.col("n_"))  # a row a part
    return first.select("first_", "n_", *columns), groups, different


def spread(first: DataFrame) -> DataFrame:
    """Every row with its number at_, from those that ``ordered`` gives."""
    columns = [c for c in first.columns if c not in ("first_", "n_")]
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / 4096)))
    pieces = first.withColumn("piece_", piece)
    pieces = pieces.where("n_ <= 4096").unionByName(pieces.where("n_ > 4096").repartition("first_", "piece_"))
    low = F.col("first_") + F.col("piece_") * 4096
    return pieces.withColumn("at_", F.explode(F.sequence(low, F.least(low + 4096, F.col("first_") + F.col("n_")) - 1))).select("at_", *columns)


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of 0, ..., n - 1 for each key: four rounds over the halves of the number's bits, again where n is passed."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "little")) for i in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        out = once(at.astype(np.uint64))
        while (beyond := out >= n).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _shuffled(n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(0, "at_", pa.array(permuted(b.column("at_").to_numpy(), n, key)))

    return run


def _matched(table: pa.Table, xs: Sequence[int], ys: Sequence[int], n: int, key: int, step: int = STEP):
    """Batches of (x3, ..., v3, ..., n_) for batches of blocks of row numbers: what of each row goes to another, what it finds there, and how often."""
    starts = table.column("first_").to_numpy()

    def coded(own: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(code of each different row by these columns alone, a row of each code)."""
        values = [table.column(f"v{i}") for i in own]
        factors = [np.unique(a.fill_null(0).to_numpy(), return_inverse=True)[1].reshape(-1) * 2 + a.is_null().to_numpy() for a in values]
        _, at, code = np.unique(joint(factors, len(table)), return_index=True, return_inverse=True)
        return code.reshape(-1), at

    (left, a_row), (right, b_row) = coded(xs), coded(ys)
    going = [table.column(f"v{i}").take(pa.array(a_row)).combine_chunks() for i in xs]
    staying = [table.column(f"v{i}").take(pa.array(b_row)).combine_chunks() for i in ys]
    names, size = [*(f"x{i}" for i in xs), *(f"v{i}" for i in ys), EQUAL], len(b_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                at = np.arange(block * step, min(n, (block + 1) * step))
                of = lambda numbers: np.searchsorted(starts, numbers, side="right") - 1
                both = left[of(at)] * size + right[of(permuted(at, n, key))]
                if len(a_row) * size <= step:
                    times = np.bincount(both)
                    found = np.flatnonzero(times)
                    times = times[found]
                else:
                    found, times = np.unique(both, return_counts=True)
                i, j = (pa.array(k) for k in np.divmod(found, size))
                yield pa.RecordBatch.from_arrays([*(c.take(i) for c in going), *(c.take(j) for c in staying), pa.array(times)], names)

    return run


@dataclass
class Result:
    edges: DataFrame
    triples: DataFrame
    summary: DataFrame
    history: DataFrame
    variables: list[Variable]
    options: Options
    scores: DataFrame | None = None
    batches: int = 0


def reconstruct(df: DataFrame, metadata: Iterable[Variable | dict] = (), black_box: Iterable[tuple[str, str]] = (), true_edges: DataFrame | None = None, age: dict[str, int] | None = None, **options) -> Result:
    """The network of a table's columns; the one that ``sample_weights`` names, if any, weighs the rows instead."""
    o, metadata = Options(**options), list(metadata)
    if o.sample_weights is not None:
        w, values = o.sample_weights, df.drop(o.sample_weights)
        if usable_weights(df, w):
            names = check_observations(values, drop_rows=False).columns
            df = df.select(*names, w).dropna(how="all", subset=names) if o.mode == "S" else df.select(*names, w)
        else:
            o = replace(o, sample_weights=None)
            df = values
    held = equal = None
    if o.sample_weights is None and df is not None and surely_discrete(df, metadata):  # all that follows needs the different rows only, so one scan does
        equal = "n_"
        while equal in df.columns:
            equal += "_"
        held = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(equal)).persist()
    try:
        if o.sample_weights is None:
            names = check_observations(held.drop(equal) if equal else df, drop_rows=False).columns
            whole = lambda t: t.dropna(how="all", subset=names) if o.mode == "S" else t
            df = whole(held.select(*names, equal) if equal else df.select(*names))
        return _reconstructed(df, equal, o, metadata, black_box, true_edges, age)
    finally:
        if held is not None:
            held.unpersist()


def _reconstructed(df: DataFrame, equal: str | None, o: Options, metadata: Iterable[Variable | dict], black_box: Iterable[tuple[str, str]], true_edges: DataFrame | None, age: dict[str, int] | None) -> Result:
    """The network of checked rows; with ``equal`` these are the different ones, and that column says how many there are of each."""
    found = variables(df.drop(*(c for c in (o.sample_weights, equal) if c)), metadata)
    at = {v.name: i for i, v in enumerate(found)}
    engine = Engine(df, found, o, equal=equal)
    try:
        black = [(at[a], at[b]) for a, b in black_box if a in at and b in at]
        r = Reconstruction(engine, o, black, {at[k]: v for k, v in age.items() if k in at} if age else None).run()
        edges, triples, history = r.edge_table(), r.triple_table(), r.history_table()
    finally:
        engine.close()
    from causalnet.operators.summary import summarise

    summary = summarise(df, edges, found, o, history, true_edges, equal)
    scores = graph.truth_scores(edges.where("connected").select("x", "y"), true_edges.toDF("x", "y")) if true_edges is not None else None
    return Result(edges, triples, summary, history, found, o, scores, engine.batches)

"""Answers to batches of information requests about the columns of one table.

Columns are observed once (numbers, hashes of levels, gaps); a batch first gets the exact places of its continuous
variables on the rows that count for each request (``plans.scales``), then its counts and searches (``plans.rounds``), and
whether gaps fall at random where that matters (``operators.neighbours``). Results are one row per request, cached on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.functions.kernel import TINY, joint
from causalnet.operators.neighbours import missing_at_random
from causalnet.plans import rounds, scales
from causalnet.plans.rounds import Request, Setting
from causalnet.plans.shipping import ship
from causalnet.sources.observations import Options, Variable

NOTHING = {"2": {"info": 0.0, "cplx": 0.0}, "3": {"i3": 0.0, "k3": 0.0, "i2": 0.0, "k2": 0.0, "score": -1e300}, "tie": {"shared": 0.0}}


def missing_at_random_rejects(x: np.ndarray, y: np.ndarray, known: np.ndarray, w: np.ndarray) -> bool:
    """Whether the rows that know z have another (x, y) distribution than all, by n KL > ln n; x and y are discrete."""
    n, nq = float(w[known].sum()), float(w.sum())
    if n <= 0 or n == nq:
        return False
    f = joint([np.unique(c, return_inverse=True)[1] for c in (x, y)], len(x))
    q, p = np.bincount(f, weights=w), np.bincount(f[known], weights=w[known], minlength=int(f.max()) + 1)
    at = p > 0
    kl = float((p[at] * np.log(p[at] / n * nq / q[at])).sum())
    return kl - np.log(n) > 0


class Engine:
    """Answers ("2", x, y, us), ("3", x, y, z, us) and ("tie", x, y, (z,)) requests over variable positions.

    The last is I'(x;z) + I'(y;z) over the rows that know all three. Where all variables are discrete, equal rows are counted once
    and stand for as many from then on; ``equal`` names a column of ``df`` that has these counts already."""

    def __init__(self, df: DataFrame, variables: list[Variable], options: Options = Options(), maxbins: int = 50, equal: str | None = None):
        self.variables, self.options = variables, options
        self.spark = df.sparkSession
        ship(self.spark)
        self.weighted = options.sample_weights is not None
        self.names = [f"v{i}" for i in range(len(variables))]
        self.kinds = {f"v{i}": v.continuous for i, v in enumerate(variables)}
        rows = rounds.observed(df, [(v.name, v.continuous) for v in variables], options.sample_weights, equal)
        self.equal = equal is not None or not (self.weighted or any(self.kinds.values()))
        if self.equal and equal is None:
            rows = rows.groupBy(*self.names).agg(F.count(F.lit(1)).alias(rounds.EQUAL))
        self.rows = rows.persist()
        total = F.coalesce(F.sum(rounds.EQUAL), F.lit(0)) if self.equal else F.count(F.lit(1))
        one = self.rows.agg(F.count(F.lit(1)).alias("held"), total.alias("n"), *(F.count(c).alias(c) for c in self.names)).collect()[0]
        self.n, self.held = one["n"], one["held"]
        self.gaps = {c for c in self.names if one[c] < self.held}
        weight = options.n_eff / self.n if 0 < options.n_eff < self.n and not self.weighted else 1.0
        start = min(30, int(0.5 + self.n ** (1 / 3)))
        self.setting = Setting(options.cplx, max(1, min(maxbins, self.n)), start, options.negative_info, weight)
        self.cache: dict = {}
        self.batches = 0

    def close(self) -> None:
        self.rows.unpersist()

    @staticmethod
    def two(x: int, y: int, us: Iterable[int] = ()) -> tuple:
        return ("2", min(x, y), max(x, y), tuple(sorted(us)))

    @staticmethod
    def three(x: int, y: int, z: int, us: Iterable[int] = ()) -> tuple:
        return ("3", min(x, y), max(x, y), z, tuple(sorted(us)))

    @staticmethod
    def tie(x: int, y: int, z: int) -> tuple:
        return ("tie", min(x, y), max(x, y), (z,))

    def get(self, request: tuple) -> dict | None:
        return self.cache.get(request)

    def measure(self, requests: Iterable[Request], rows: DataFrame | None = None) -> None:
        """Find the places that these requests need and that are not known yet."""
        wanted = {(c, rounds.contexts(r, self.gaps)) for r in requests for c in r.columns if self.kinds[c]}
        new = sorted(k for k in wanted if k not in self.setting.scales)
        if new:
            tallies = scales.tally(self.rows if rows is None else rows, new, "w_" if self.weighted else None)
            self.setting.scales |= dict(zip(new, scales.places(tallies, len(new), self.setting.maxbins)))

    def _biased(self, todo: list[tuple]) -> set[tuple]:
        """Three-point requests with a continuous x or y whose third variable's gaps don't fall at random."""
        v = lambda i: f"v{i}"
        ask = [q for q in todo if q[0] == "3" and self.options.test_mar and v(q[3]) in self.gaps and (self.kinds[v(q[1])] or self.kinds[v(q[2])])]
        if not ask:
            return set()
        tests = [(v(q[1]), v(q[2]), v(q[3]), [v(u) for u in q[4]]) for q in ask]
        found = missing_at_random(self.rows.where("w_ > 0") if self.weighted else self.rows, tests, {c for c, number in self.kinds.items() if number})
        return {q for q, (n1, n2, kl) in zip(ask, found) if 2 < n1 < n2 and kl - np.log(n1) > 0}

    def moved(self, rows: DataFrame, pairs: list[tuple[str, str]], source: Callable | None = None) -> dict[int, float]:
        """I' of each pair of columns of a table whose column x3 is a shuffled v3; by place in the list. A ``source``
        makes these columns, and n_, from ``rows`` in the tasks that count (discrete variables only)."""
        name = lambda c: f"v{c[1:]}"
        columns = {c for p in pairs for c in p}
        gaps = {c for c in columns if name(c) in self.gaps}
        kinds = {c: self.kinds[name(c)] for c in columns}
        asked = [Request("2", p) for p in pairs]
        wanted = {(c, rounds.contexts(r, gaps)) for r in asked for c in r.columns if kinds[c]}
        setting = replace(self.setting, scales={(c, o): self.setting.scales[name(c), ()] for c, o in wanted if not o and (name(c), ()) in self.setting.scales})
        if new := sorted(wanted - setting.scales.keys()):
            setting.scales |= dict(zip(new, scales.places(scales.tally(rows, new, "w_" if self.weighted else None), len(new), setting.maxbins)))
        found = rounds.solve(rows, asked, kinds, gaps, setting, self.weighted, n_rows=self.n, equal=source is not None, source=source)
        return {k: found[k]["info"] - found[k]["cplx"] if k in found else 0.0 for k in range(len(pairs))}

    def run(self, requests: Iterable[tuple]) -> None:
        todo = [r for r in dict.fromkeys(requests) if r not in self.cache]
        if not todo:
            return
        self.batches += 1
        biased = self._biased(todo)
        for q in biased:
            self.cache[q] = {"n": 0.0} | NOTHING["3"]
        todo = [q for q in todo if q not in biased]
        asked = []
        for q in todo:
            own = (q[1], q[2], *([q[3], *q[4]] if q[0] == "3" else q[3]))
            columns = tuple(f"v{i}" for i in own)
            discrete = not (self.kinds[columns[0]] or self.kinds[columns[1]])
            asked.append(Request(q[0], columns, q[0] == "3" and self.options.test_mar and columns[2] in self.gaps and discrete))
        self.measure(asked)
        setting = self.setting

        def finish(r: Request, codes, whole, w, m, sample) -> dict:
            if r.kind != "2" and (m[whole].sum() <= 2 or (r.third and missing_at_random_rejects(codes[0], codes[1], whole, w))):
                return {"n": float(w[whole].sum())} | NOTHING[r.kind]
            s = sample()
            return rounds.plain(s.run(rounds.begin(s.search, r.kind, len(r.columns), setting)))

        found = rounds.solve(self.rows, asked, self.kinds, self.gaps, setting, self.weighted, finish, self.held, equal=self.equal)
        small = lambda v: 0.0 if abs(v) < TINY else v
        for k, q in enumerate(todo):
            r = found.get(k, {"n": 0.0} | NOTHING[q[0]])
            self.cache[q] = {"n": r["n"], "info": small(r["info"]), "cplx": small(r["cplx"])} if q[0] == "2" else r

"""Information of mixed discrete and continuous variables, from contingency tables.

A variable has places: its levels if it is discrete, else runs of neighbouring values, in order. A continuous one is
cut into bins of places. What is maximised is information less complexity, where a variable of r bins out of m
places also pays log C(m - 1, r - 1) for the choice of its cuts. All variables take their best cuts at once, given
the others' former bins, over and over; when the value comes back to an earlier one, the mean over the cycle is the result.

The searches are generators: they ask for tables of counts of some variables, each with a map from places to bins, and
go on with the answers. So the same search runs on a small table of all places that one task holds (``Sample``), or
on tables that Spark counts afresh for each round (``plans.rounds``), whose size follows the bins and not the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field

import numpy as np

from causalnet.functions.complexity import log_c_array, log_choose, nln

EPSILON = 1e-5  # convergence, and the least gain of a cut
TINY = 1e-10
MOST_STEPS = 50
U_SWEEPS = 3
MOST_BINS_AT_FIRST = 30  # of any equal-frequency start


@dataclass(frozen=True)
class Info:
    n: float
    info: float
    cplx: float
    cuts: list = field(default_factory=list, compare=False)

    @property
    def shifted(self) -> float:
        return self.info - self.cplx


def dense(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].reshape(-1)


def joint(factors: Sequence[np.ndarray], n: int) -> np.ndarray:
    """One dense code for the rows' combinations."""
    out = np.zeros(n, np.int64)
    for f in factors:
        out = dense(out * (int(f.max(initial=0)) + 1) + f)
    return out


def counts(factor: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.bincount(factor, weights=w)


def whole(c: np.ndarray) -> np.ndarray:
    return np.floor(c + 0.5).astype(np.int64)


def block(a: np.ndarray, b: np.ndarray, w: np.ndarray, ra: int, rb: int, cplx: str, conditional: bool = False) -> tuple[float, float]:
    """Information of two factors and its complexity, symmetric or of ``a`` given ``b``."""
    na, nb, n = counts(a, w), counts(b, w), float(w.sum())
    info = nln(counts(joint([a, b], len(a)), w)).sum() - nln(na).sum() - nln(nb).sum() + n * math.log(n)
    if cplx == "bic":
        k = 0.5 * math.log(n) * (ra - 1) * (rb - 1)
    else:
        at_least_one = lambda c: np.maximum(whole(c[c > 0]), 1)
        k = float(log_c_array(at_least_one(nb), ra).sum())
        if not conditional:
            whole_n = np.array([whole(np.array([n]))[0]])
            k = 0.5 * (k + float(log_c_array(at_least_one(na), rb).sum()) - float((log_c_array(whole_n, ra) + log_c_array(whole_n, rb))[0]))
    return (0.0 if info < TINY or ra <= 1 or rb <= 1 else float(info)), k


def equal_frequency_bins(value_counts: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each value in order: a cut every n/bins rows, put off to the end of a run of equal
    values; after a long run each following value opens a bin until the cuts are caught up with."""
    n = int(round(float(value_counts.sum())))
    bins = min(bins, len(value_counts))
    size = n // bins
    if size < 1:
        size, bins = 1, n
    before = np.cumsum(value_counts) - value_counts
    raw = np.minimum(before // size, bins - 1)
    j = np.arange(len(raw))
    return (j + np.minimum.accumulate(raw - j)).astype(np.int64)


def groups_of(levels: int, maxbins: int) -> np.ndarray:
    """Group of each of ``levels`` values in order: at most ``maxbins`` groups of as many values each; cuts lie between groups."""
    return np.arange(levels) // max(1, math.ceil(levels / maxbins))


def best_cuts(group: np.ndarray, inner: np.ndarray, outer: np.ndarray, w: np.ndarray, rows: np.ndarray, other_levels: int, before: int, cplx: str) -> np.ndarray:
    """Bin of each group that maximises, over all ways to cut between groups, the sum over bins of (n ln n over the inner
    factor, less that over the outer one, less the complexity of ``other_levels`` given the outer factor), less the cost of the
    cuts. A cut costs what it did on average when there were ``before`` bins; from one bin nothing is cut any more.

    ``group``, ``inner`` and ``outer`` are codes of the cells of a table, ``w`` their weights and ``rows`` their
    rows; where these differ, a bin's counts are its rows by its mean weight, in whole numbers.
    best[e] is the best sum over the first e groups, origin[e] the group at which its last bin begins."""
    m = int(group.max(initial=0)) + 1
    if cplx == "nml" and before < 2:
        return np.zeros(m, np.int64)
    weighted = not np.array_equal(w, rows)

    def upto(f: np.ndarray, amount: np.ndarray) -> np.ndarray:
        """Amounts in the first 0, 1, ..., m groups at each level of a factor."""
        k = int(f.max(initial=0)) + 1
        return np.vstack([np.zeros(k), np.cumsum(np.bincount(group * k + f, weights=amount, minlength=m * k).reshape(m, k), axis=0)])

    together, given = upto(inner, rows), upto(outer, rows)
    weight, size = (upto(np.zeros(len(group), np.int64), a)[:, 0] for a in (w, rows))
    each = 0.5 * (other_levels - 1) * given.shape[1] * math.log(max(float(rows.sum()), 1.0))
    cost = max(0.0, log_choose(m - 1, before - 1)) / (before - 1) if cplx == "nml" and before <= m else 0.0
    best, origin = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for e in range(1, m + 1):
        a, b = together[e] - together[:e], given[e] - given[:e]
        present = b > 0
        if weighted:
            share = ((weight[e] - weight[:e]) / (size[e] - size[:e]))[:, None]
            a, b = np.floor(share * a + 0.5), np.floor(share * b + 0.5)
        paid = log_c_array(whole(b), other_levels).sum(axis=1) if cplx == "nml" else each * present.sum(axis=1)
        worth = nln(a).sum(axis=1) - nln(b).sum(axis=1) - paid
        best[e] = worth[0]
        for at, total in enumerate((best[1:e] + worth[1:e] - cost).tolist(), 1):
            if total - best[e] > EPSILON:
                best[e], origin[e] = total, at
    starts, e = [], m
    while e:
        e = int(origin[e])
        starts.append(e)
    return np.searchsorted(np.sort(np.array(starts)), np.arange(m), side="right").astype(np.int64) - 1


@dataclass
class Scale:
    """Places of one variable on the rows at hand: its number of distinct values, and if it can be cut, the group of each
    place and its equal-frequency bin for a number of bins."""

    levels: int
    group: np.ndarray | None = None
    equal: Callable[[int], np.ndarray] | None = None

    @property
    def continuous(self) -> bool:
        return self.group is not None

    @classmethod
    def of_values(cls, rows: np.ndarray, maxbins: int) -> Scale:
        """Each value is a place; ``rows`` has the rows of each."""
        return cls(len(rows), groups_of(len(rows), maxbins), lambda bins: equal_frequency_bins(rows, bins))


@dataclass
class Table:
    """Cells that occur: a column of bins for each variable asked for, weights and rows."""

    bins: list[np.ndarray]
    w: np.ndarray
    rows: np.ndarray

    def tie(self, columns: Sequence[int]) -> np.ndarray:
        return joint([self.bins[c] for c in columns], len(self.w))


#: What a search asks for: tables, each of some (variable, bin of each of its places).
Asked = list[list[tuple[int, np.ndarray]]]
Search_of = Generator[Asked, list[Table], object]


def run(search: Search_of, answer: Callable[[Asked], list[Table]]):
    """The result of a search whose questions ``answer`` answers."""
    try:
        asked = next(search)
        while True:
            asked = search.send(answer(asked))
    except StopIteration as e:
        return e.value


def together(searches: Sequence[Search_of]) -> Search_of:
    """Several searches side by side: their questions of one round are asked as one."""
    out, live = [None] * len(searches), {}

    def step(i: int, send) -> None:
        try:
            live[i] = send()
        except StopIteration as e:
            live.pop(i, None)
            out[i] = e.value

    for i, s in enumerate(searches):
        step(i, lambda s=s: next(s))
    while live:
        asked = dict(live)
        got = yield [q for a in asked.values() for q in a]
        at = 0
        for i, a in asked.items():
            part, at = got[at : at + len(a)], at + len(a)
            step(i, lambda i=i, part=part: searches[i].send(part))
    return out


def bins_of(m: np.ndarray) -> int:
    return int(m.max(initial=0)) + 1


def mean_of_cycle(history: list[tuple[float, float]]) -> tuple[float, float] | None:
    """Mean (info, shifted) from the last earlier step whose shifted value is the newest one's up to the newest, if there is one."""
    for i in range(len(history) - 2, -1, -1):
        if abs(history[-1][1] - history[i][1]) < EPSILON:
            return tuple(float(v) for v in np.mean(history[i:-1], axis=0))
    return None


class Search:
    """Searches over the variables of ``scales``; ``n`` is the sum of weights, ``initbins`` the bins of the last resort."""

    def __init__(self, scales: Sequence[Scale], n: float, cplx: str = "nml", maxbins: int = 50, initbins: int = 30):
        self.scales, self.n, self.cplx, self.maxbins, self.initbins = list(scales), n, cplx, maxbins, initbins

    def _map(self, v: int, bins: int) -> np.ndarray:
        s = self.scales[v]
        return s.equal(bins) if s.continuous else np.arange(s.levels)

    def _cut_cost(self, v: int, bins: int) -> float:
        most = min(self.maxbins, self.scales[v].levels)
        return log_choose(most - 1, bins - 1) if self.scales[v].continuous and 1 < bins < most else 0.0

    def _starts(self, vs: Sequence[int]) -> Sequence[int]:
        least = min((self.scales[v].levels for v in vs if self.scales[v].continuous), default=0)
        return range(2, min(self.initbins, 20, least)) or [self.initbins]

    def _result(self, info: float, shifted: float, negative_info: bool, cuts: list) -> Info:
        if shifted < 0 and not negative_info:
            info = shifted = 0.0
        return Info(self.n, float(info), float(info - shifted), cuts)

    def _nothing(self, x: int, y: int) -> bool:
        return self.n <= 2 or self.scales[x].levels <= 1 or self.scales[y].levels <= 1

    def _grouped(self, v: int) -> tuple[int, np.ndarray]:
        return v, self.scales[v].group

    def _best(self, v: int, t: Table, inner: Sequence[int], outer: Sequence[int], other_levels: int, before: int) -> np.ndarray:
        """New bins of the places of v, whose groups are the table's first column."""
        found = best_cuts(t.bins[0], t.tie(inner), t.tie(outer), t.w, t.rows, other_levels, before, self.cplx)
        return found[self.scales[v].group]

    def mutual(self, x: int, y: int, negative_info: bool = False) -> Search_of:
        """I(x;y); of two discrete variables it is not clamped at zero."""
        if self._nothing(x, y):
            return Info(self.n, 0.0, 0.0)
        turns = [v for v in (x, y) if self.scales[v].continuous]

        def value(t: Table, m: dict) -> tuple[float, float]:
            i, k = block(*t.bins, t.w, bins_of(m[x]), bins_of(m[y]), self.cplx)
            return i, i - k

        if not turns:
            m = {v: self._map(v, 0) for v in (x, y)}
            (t,) = yield [[*m.items()]]
            i, shifted = value(t, m)
            return Info(self.n, i, i - shifted)
        starts = [{v: self._map(v, b) for v in (x, y)} for b in self._starts((x, y))]
        tables = yield [[*m.items()] for m in starts]
        m = max(zip(tables, starts), key=lambda s: value(*s)[1])[1]
        history, rounds, result = [], [], (0.0, 0.0)
        for _ in range(MOST_STEPS):
            tables = yield [[self._grouped(v), (y if v == x else x, m[y if v == x else x])] for v in turns]
            m = m | {v: self._best(v, t, [1], [], bins_of(m[y if v == x else x]), bins_of(m[v])) for v, t in zip(turns, tables)}
            (t,) = yield [[*m.items()]]
            i, shifted = value(t, m)
            history.append((i, shifted - sum(self._cut_cost(v, bins_of(m[v])) for v in (x, y))))
            rounds.append([np.flatnonzero(np.diff(m[v])) for v in (x, y)])
            result = mean_of_cycle(history)
            if result or len(turns) < 2:
                result = result or history[-1]
                break
            result = history[-1]
        return self._result(*result, negative_info, rounds)

    def discrete_conditional(self, x: int, y: int, us: Sequence[int], negative_info: bool = False) -> Search_of:
        (t,) = yield [[(v, self._map(v, 0)) for v in (x, y, *us)]]
        fx, fy, fu = t.bins[0], t.bins[1], t.tie(range(2, 2 + len(us)))
        nu, nxu, nyu = (counts(joint(s, len(fx)), t.w) for s in ([fu], [fx, fu], [fy, fu]))
        info = nln(counts(joint([fx, fy, fu], len(fx)), t.w)).sum() + nln(nu).sum() - nln(nxu).sum() - nln(nyu).sum()
        rx, ry = self.scales[x].levels, self.scales[y].levels
        if self.cplx == "bic":
            k = 0.5 * math.log(self.n) * (rx - 1) * (ry - 1) * float(np.prod([self.scales[u].levels for u in us]))
        else:
            c = lambda t, r: float(log_c_array(np.maximum(whole(t[t > 0]), 1), r).sum())
            k = 0.5 * (c(nxu, ry) - c(nu, ry) + c(nyu, rx) - c(nu, rx))
        info = 0.0 if info < TINY else float(info)
        if not negative_info and info - k < 0:
            return Info(self.n, 0.0, 0.0)
        return Info(self.n, info, k)

    def _fitted(self, a: int, beside: Sequence[int], us: Sequence[int], m: dict, first: int) -> Search_of:
        """The bins of us that tell most about a, together with ``beside``, less their complexity."""
        own = m | {u: self._map(u, first) for u in us}
        turns = [u for u in us if self.scales[u].continuous]
        for _ in range(U_SWEEPS if len(us) > 1 else 1):
            if not turns:
                break
            rest = {u: [*(v for v in us if v != u), *beside] for u in turns}
            tables = yield [[self._grouped(u), *((v, own[v]) for v in rest[u]), (a, own[a])] for u in turns]
            sides = {u: list(range(1, 1 + len(rest[u]))) for u in turns}
            own = own | {u: self._best(u, t, [*sides[u], len(sides[u]) + 1], sides[u], bins_of(own[a]), bins_of(own[u])) for u, t in zip(turns, tables)}
        return {u: own[u] for u in us}

    def conditional(self, x: int, y: int, us: Sequence[int], negative_info: bool = False, mixed: bool = False) -> Search_of:
        """I(x;y|us): half of [I(x;y,us) - I(x;us)] + [I(y;x,us) - I(y;us)], each term with its own best cuts of us.

        Where the cuts of us that suit a term of two variables are worse than those of its part, the latter serve for both from then
        on. Discrete variables alone have a closed form, unless ``mixed``."""
        us = list(us)
        if not us:
            return (yield from self.mutual(x, y, negative_info))
        if self._nothing(x, y):
            return Info(self.n, 0.0, 0.0)
        if not mixed and not any(self.scales[v].continuous for v in (x, y, *us)):
            return (yield from self.discrete_conditional(x, y, us, negative_info))
        first = min(MOST_BINS_AT_FIRST, max(2, int(0.5 + self.n ** (1 / (2 + len(us))))))

        def gain(t: Table, a: int) -> tuple[float, float]:
            """Information of the first column, of variable a with its bins, about the others; and less its complexity."""
            b = t.tie(range(1, len(t.bins)))
            i, k = block(t.bins[0], b, t.w, a, int(b.max(initial=0)) + 1, self.cplx, True)
            return i, i - k

        starts = [{v: self._map(v, b) for v in (x, y, *us)} for b in self._starts((x, y, *us))]
        tables = yield [[(a, s[a]), (o, s[o]), *((u, s[u]) for u in us)] for s in starts for a, o in ((x, y), (y, x))]
        sums = [gain(tables[2 * i], bins_of(s[x]))[1] + gain(tables[2 * i + 1], bins_of(s[y]))[1] for i, s in enumerate(starts)]
        m = {v: starts[int(np.argmax(sums))][v] for v in (x, y)}
        sides = ((x, y), (y, x))
        alone: dict[int, dict] = {}
        reuse = {x: False, y: False}
        history, rounds, result, step, last = [], [], (0.0, 0.0), 0, MOST_STEPS - 1
        while step <= last:
            wanted = [(a, beside) for a, o in sides if not reuse[a] for beside in ((o,), ())]
            found = yield from together([self._fitted(a, beside, us, m, first) for a, beside in wanted])
            fits = dict(zip(wanted, found))
            both = {a: alone[a] if reuse[a] else fits[a, (o,)] for a, o in sides}
            alone = {a: alone[a] if reuse[a] else fits[a, ()] for a, _ in sides}
            asked = []
            for a, o in sides:
                asked += [[(a, m[a]), (o, m[o]), *both[a].items()], [(a, m[a]), *alone[a].items()]]
                if self.scales[o].continuous:
                    asked.append([self._grouped(o), (a, m[a]), *both[a].items()])
            tables = iter((yield asked))
            part, parts_shifted, new = {}, 0.0, {}
            for a, o in sides:
                ra, ro = bins_of(m[a]), bins_of(m[o])
                (i, shifted), (i_alone, shifted_alone) = gain(next(tables), ra), gain(next(tables), ra)
                part[a] = i - i_alone
                parts_shifted += shifted - self._cut_cost(o, ro) - shifted_alone
                if self.scales[o].continuous:
                    t = next(tables)
                    rest = list(range(2, len(t.bins)))
                    new[o] = self._best(o, t, [1, *rest], rest, ra, ro)
            m = m | new
            rounds.append([np.flatnonzero(np.diff(m[v])) for v in (x, y)])
            reuse = {a: part[a] < TINY or (reuse[a] and part[o] < TINY) for a, o in sides}
            step += 1
            if any(reuse.values()):
                if not min(bins_of(m[x]), bins_of(m[y])) == 1:
                    continue
                if step <= last:
                    last = step  # of one bin nothing comes any more
            history.append((0.5 * sum(part.values()), 0.5 * parts_shifted))
            if mean := mean_of_cycle(history):
                result = mean
                break
            result = history[-1]
        return self._result(*result, negative_info, rounds)

    def three_point(self, x: int, y: int, z: int, us: Sequence[int] = (), negative_info: bool = False) -> Search_of:
        """i3, k3, i2, k2 and the score of z as a contributor to (x, y)."""
        us = list(us)
        mixed = any(self.scales[v].continuous for v in (x, y, z, *us))
        found = yield from together([self.conditional(a, b, given, negative_info, mixed) for a, b, given in ((x, y, us), (x, y, [*us, z]), (x, z, us), (y, z, us))])
        # Of discrete variables each term is clamped at zero; of others the searches have done so where it applies.
        (i2, k2), (iz, kz), (ix, kx), (iy, ky) = ((0.0, 0.0) if r.shifted < 0 and not mixed else (r.info, r.cplx) for r in found)
        i3, k3 = i2 - iz, k2 - kz
        if abs(i3 - k3) < TINY:
            i3 = k3
        a, b = (ix - kx) - (i2 - k2), (iy - ky) - (i2 - k2)
        score = min(i3 - k3, min(a, b) - math.log1p(math.exp(-abs(a - b))))
        return {"n": self.n, "i3": i3, "k3": k3, "i2": i2, "k2": k2, "score": 0.0 if abs(score) < TINY else score}


def tables_of(codes: Sequence[np.ndarray], w: np.ndarray, rows: np.ndarray, asked: Asked) -> list[Table]:
    """The tables, from cells given by the codes of their places."""
    out = []
    for columns in asked:
        sizes = [bins_of(m) for _, m in columns]
        total = math.prod(sizes)
        mapped = [m[codes[v]] for v, m in columns]
        if total <= 1 << 18:
            code = np.zeros(len(w), np.int64)
            for b, size in zip(mapped, sizes):
                code = code * size + b
            at = np.flatnonzero(np.bincount(code, minlength=total))
            place = np.zeros(total, np.int64)
            place[at] = np.arange(len(at))
            code, bins = place[code], []
            for size in reversed(sizes):
                at, b = np.divmod(at, size)
                bins.insert(0, b)
        else:
            code, first = joint(mapped, len(w)), None
            first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
            first[code] = np.arange(len(code))
            bins = [b[first] for b in mapped]
        out.append(Table(bins, counts(code, w), counts(code, rows)))
    return out


class Sample:
    """Searches on cells that one task holds: the codes of their places in each variable, their weights and rows."""

    def __init__(self, codes: Sequence[np.ndarray], continuous: Sequence[bool], weights: np.ndarray | None = None, cplx: str = "nml", maxbins: int = 50, initbins: int | None = None, n_samples: int | None = None, rows: np.ndarray | None = None, scales: Sequence[Scale | None] | None = None):
        """Codes are those of values in order, unless ``scales`` has the places of a variable."""
        given = list(scales) if scales is not None else [None] * len(codes)
        self.codes = [np.asarray(c) if s is not None else dense(np.asarray(c)) for c, s in zip(codes, given)]
        self.n_rows = len(self.codes[0])
        self.rows = np.ones(self.n_rows) if rows is None else np.asarray(rows, float)
        self.w = self.rows if weights is None else np.asarray(weights, float)
        self.n = float(self.w.sum())
        # A continuous variable with under three values on these rows is discrete.
        self.scales = []
        for v, (c, s) in enumerate(zip(continuous, given)):
            if s is None:
                r = int(self.codes[v].max(initial=-1)) + 1
                s = Scale.of_values(counts(self.codes[v], self.rows), maxbins) if c and r > 2 else Scale(r)
            self.scales.append(s)
        n = n_samples or int(round(float(self.rows.sum())))
        self.search = Search(self.scales, self.n, cplx, maxbins, initbins or min(30, int(0.5 + n ** (1 / 3))))

    def run(self, search: Search_of):
        return run(search, lambda asked: tables_of(self.codes, self.w, self.rows, asked))

    def mutual(self, x: int = 0, y: int = 1, negative_info: bool = False) -> Info:
        return self.run(self.search.mutual(x, y, negative_info))

    def conditional(self, x: int, y: int, us: Sequence[int], negative_info: bool = False) -> Info:
        return self.run(self.search.conditional(x, y, us, negative_info))

    def three_point(self, x: int, y: int, z: int, us: Sequence[int] = (), negative_info: bool = False) -> dict[str, float]:
        return self.run(self.search.three_point(x, y, z, us, negative_info))


def histogram_cuts(values: np.ndarray, weights: np.ndarray | None = None, max_bins: int = 20, epsilon: float = 1e-3) -> list[float]:
    """Cut points of the minimum-description-length histogram: candidates are the midpoints of
    neighbouring values; ends lie ``epsilon`` outside. Textbook back-trace."""
    order = np.argsort(values, kind="stable")
    v = np.asarray(values, float)[order]
    w = np.ones(len(v)) if weights is None else np.asarray(weights, float)[order]
    u, at = np.unique(v, return_inverse=True)
    c = np.bincount(at, weights=w)
    n = float(c.sum())
    ends = np.concatenate([[u[0] - epsilon], (u[:-1] + u[1:]) / 2, [u[-1] + epsilon]])
    below = np.concatenate([[0.0], np.cumsum(c)])
    e = len(ends) - 2
    most = min(max_bins, e + 1)

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        k = below[b] - below[a]
        return np.where(k > 0, -k * (np.log(np.maximum(k, 1e-300) * epsilon) - np.log(n * (ends[b] - ends[a]))), 0.0)

    score = np.array([cost(np.array([0]), b)[0] for b in range(1, e + 2)])
    trace, best = [np.zeros(e + 1, np.int64)], (score[-1], 1)
    for k in range(2, most + 1):
        new, back = np.full(e + 1, np.inf), np.zeros(e + 1, np.int64)
        extra = log_c_array(np.array([int(round(n))]), k)[0] - log_c_array(np.array([int(round(n))]), k - 1)[0] + math.log((e - k + 2) / (k - 1)) if e - k + 2 > 0 else math.inf
        for b in range(k, e + 2):
            a = np.arange(k - 1, b)
            total = score[a - 1] + cost(a, b)
            j = int(np.argmin(total))
            new[b - 1], back[b - 1] = total[j] + extra, a[j]
        score = new
        trace.append(back)
        if score[-1] < best[0] - 1e-12:
            best = (score[-1], k)
    cuts, b = [float(ends[-1])], e + 1
    for k in range(best[1], 1, -1):
        b = int(trace[k - 1][b - 1])
        cuts.append(float(ends[b]))
    return [float(ends[0]), *reversed(cuts)]

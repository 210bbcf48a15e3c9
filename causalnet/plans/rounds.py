"""Counting for batches of information requests.

``cells`` counts the combinations of places that occur for any number of requests in one job: a table of requests goes
to the tasks, which count their rows of an Arrow batch at a time, and Spark adds up what they found. The plan has
the same few operators however many requests there are.

``solve`` finishes them. Requests with at most ``HELD`` cells go through their search in one task each, all in one job.
The others are searched in rounds: each round is one job that counts, for all of them, the tables that their searches
ask for next. These follow the bins of the moment, so no task and no answer grows with the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.functions.kernel import Sample, Scale, Search, Table, bins_of, joint, tables_of, together
from causalnet.plans.scales import Places

#: Cells that one task may hold for a request.
HELD = 200_000
#: Cells that a task passes on at a time.
SENT = 1 << 19


@dataclass(frozen=True)
class Request:
    """A search over ``columns``: its kind and parameters. Rows must know all columns; where ``third`` is set, rows that
    lack the third one alone are counted too, apart from the others."""

    kind: str
    columns: tuple[str, ...]
    third: bool = False


@dataclass
class Setting:
    """What searches need beside counts."""

    cplx: str = "nml"
    maxbins: int = 50
    initbins: int = 30
    negative_info: bool = False
    weight: float = 1.0
    scales: dict = field(default_factory=dict)  # (column, known columns) -> Places


#: Column with the number of equal rows that a row stands for.
EQUAL = "n_"


def observed(df: DataFrame, columns: Sequence[tuple[str, bool]], weights: str | None = None, equal: str | None = None) -> DataFrame:
    """Columns v0, v1, ...: continuous ones as numbers, levels of the others as 64-bit hashes (of a million levels two meet with a
    probability of 3 in 100 million), null where unknown; w_ if there are weights; n_ from ``equal``, if equal rows are already one."""
    level = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c)))
    more = ([F.col(weights).cast("double").alias("w_")] if weights else []) + ([F.col(f"`{equal}`").alias(EQUAL)] if equal else [])
    number_of = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.select(*((number_of(f"`{c}`") if number else level(f"`{c}`")).alias(f"v{i}") for i, (c, number) in enumerate(columns)), *more)


def contexts(request: Request, gaps: set[str]) -> tuple[str, ...]:
    """The columns that decide which rows count for a request."""
    return tuple(sorted(set(request.columns) & gaps))


def cells(rows: DataFrame, requests: Sequence[Request], scales: dict[tuple[str, tuple[str, ...]], Places], gaps: set[str], weighted: bool, equal: bool = False, source: Callable | None = None) -> DataFrame:
    """(k, whole, c0, c1, ..., w, m): weights and rows of the combinations of each request's columns; c has places of continuous
    columns and hashes of levels. ``whole`` is false for rows that lack the third column. With ``equal`` a row stands for n_ rows.
    ``source`` makes batches with the columns from those of ``rows``, in the same tasks."""
    width = max(len(r.columns) for r in requests)
    plan = [(r.columns, contexts(r, gaps), r.third) for r in requests]
    wanted = {key: p for key, p in scales.items() if p is not None and any(key[0] in c and key[1] == o for c, o, _ in plan)}
    columns = sorted({c for r in requests for c in r.columns}) + (["w_"] if weighted else []) + ([EQUAL] if equal else [])
    names = ["k", "whole", *(f"c{j}" for j in range(width)), "w", "m"]
    types = [pa.int32(), pa.bool_(), *([pa.int64()] * width), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source(batches) if source else batches:
            known = {c: b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns}
            times = b.column(EQUAL).to_numpy().astype(float) if equal else np.ones(len(b))
            w = times * b.column("w_").fill_null(0.0).to_numpy(zero_copy_only=False) if weighted else times
            coded: dict = {}

            def code(c: str, others: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
                """(number of each row's code in this batch, the codes); 0 where unknown."""
                key = (c, others) if (c, others) in wanted else c
                if key not in coded:
                    a = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                    values, at = np.unique(a, return_inverse=True)
                    if key != c:
                        values, again = np.unique(wanted[key].of(values), return_inverse=True)
                        at = again[at]
                    coded[key] = at.reshape(-1), values.astype(np.int64)
                return coded[key]

            out, held = [[] for _ in names], 0
            for k, (own, others, third) in enumerate(plan):
                every = w > 0
                for j, c in enumerate(own):
                    if c in gaps and not (third and j == 2):
                        every = every & known[c]
                rows_at = np.flatnonzero(every)
                if not len(rows_at):
                    continue
                parts = [code(c, others) for c in own]
                whole = known[own[2]][rows_at] if third else np.ones(len(rows_at), bool)
                space = math.prod(len(v) for _, v in parts) * 2
                number = whole.astype(np.int64)
                if space < 1 << 62:
                    for at, v in parts:
                        number = number * len(v) + at[rows_at]
                else:
                    number = joint([number, *(at[rows_at] for at, _ in parts)], len(rows_at))
                _, first, inverse = np.unique(number, return_index=True, return_inverse=True)
                one, m = rows_at[first], np.bincount(inverse.reshape(-1), weights=times[rows_at])
                for i, v in enumerate([np.full(len(one), k), whole[first], *(parts[j][1][parts[j][0][one]] if j < len(own) else np.zeros(len(one), np.int64) for j in range(width)), np.bincount(inverse.reshape(-1), weights=w[rows_at]), m]):
                    out[i].append(v)
                held += len(one)
                if held >= SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(out, types)], names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(out, types)], names)

    schema = "k int, whole boolean, " + "".join(f"c{j} long, " for j in range(width)) + "w double, m double"
    return (rows if source else rows.select(*columns)).mapInArrow(run, schema).groupBy(*names[:-2]).agg(F.sum("w").alias("w"), F.sum("m").alias("m"))


def begin(search: Search, kind: str, n_columns: int, o: Setting):
    """The search of a kind over its columns in order."""
    rest = list(range(2, n_columns))
    if kind == "2":
        return search.conditional(0, 1, rest, o.negative_info)
    if kind == "3":
        return search.three_point(0, 1, 2, rest[1:], o.negative_info)
    if kind == "tie":
        return _shared(search, o)
    raise ValueError(kind)


def _shared(search: Search, o: Setting):
    """What the third variable shares with the first and with the second, less complexity."""
    found = yield from together([search.mutual(v, 2, o.negative_info) for v in (0, 1)])
    return {"n": search.n, "shared": sum(r.shifted for r in found)}


def biased_levels(counted: DataFrame, weight: float) -> dict[int, bool]:
    """Of requests with rows that lack the third column: whether the levels of the first two are distributed otherwise among
    the rows that know it than among all, by n KL > ln n."""
    pairs = counted.groupBy("k", "c0", "c1").agg(F.sum("w").alias("q"), F.sum(F.when(F.col("whole"), F.col("w")).otherwise(0.0)).alias("p"))
    sums = pairs.groupBy("k").agg(F.sum("q").alias("nq"), F.sum("p").alias("n"), F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.col("q")))).alias("s"))
    out = {}
    for r in sums.collect():
        n = r["n"] * weight
        out[r["k"]] = 0 < r["n"] < r["nq"] and weight * (r["s"] + r["n"] * math.log(r["nq"] / r["n"])) > math.log(n)
    return out


def plain(found) -> dict:
    """A search's result as numbers and lists."""
    if isinstance(found, dict):
        return {k: float(v) for k, v in found.items()}
    return {"n": float(found.n), "info": float(found.info), "cplx": float(found.cplx), "cuts": [[c.tolist() for c in both] for both in found.cuts]}


def _scales(r: Request, o: Setting, gaps: set[str], kinds: dict[str, bool]) -> list[Scale | None]:
    return [o.scales[c, contexts(r, gaps)].scale() if kinds[c] and o.scales.get((c, contexts(r, gaps))) else None for c in r.columns]


def solve(rows: DataFrame, requests: Sequence[Request], kinds: dict[str, bool], gaps: set[str], o: Setting, weighted: bool, finish: Callable | None = None, n_rows: int | None = None, held: int = HELD, equal: bool = False, source: Callable | None = None) -> dict[int, dict]:
    """Results by the request's place in the list; those without a row are left out.

    ``finish(r, codes, whole, w, m, sample)`` turns a request's cells into its result where they fit a task, with ``sample()`` to make a
    ``Sample`` of the whole ones; by default the request's own search does. A request whose cells don't fit goes its search in rounds.
    No request may have more cells than ``n_rows``. ``equal`` and ``source`` are those of ``cells``."""
    if not requests:
        return {}
    requests = list(requests)
    counted = cells(rows, requests, o.scales, gaps, weighted, equal, source)
    width = max(len(r.columns) for r in requests)
    large: list[int] = []
    if n_rows is None or n_rows > held:
        counted = counted.persist()
        large = [r["k"] for r in counted.groupBy("k").count().where(F.col("count") > held).collect()]

    def one(key, pdf):
        import pandas as pd

        k = int(key[0])
        r = requests[k]
        codes = [pdf[f"c{j}"].to_numpy() for j in range(len(r.columns))]
        whole, w, m = pdf["whole"].to_numpy(), pdf["w"].to_numpy() * o.weight, pdf["m"].to_numpy()

        def sample() -> Sample:
            return Sample([c[whole] for c in codes], [kinds[c] for c in r.columns], w[whole], o.cplx, o.maxbins, o.initbins, rows=m[whole], scales=_scales(r, o, gaps, kinds))

        if finish is not None:
            out = finish(r, codes, whole, w, m, sample)
        else:
            s = sample()
            out = plain(s.run(begin(s.search, r.kind, len(r.columns), o)))
        return pd.DataFrame({"k": [k], "found": [json.dumps(out)]})

    try:
        small = counted.where(~F.col("k").isin(large)) if large else counted
        out = {r["k"]: json.loads(r["found"]) for r in small.groupBy("k").applyInPandas(one, "k int, found string").collect()}
        if large:
            big = counted.where(F.col("k").isin(large))
            third = [k for k in large if requests[k].third]
            biased = {k for k, no in biased_levels(big.where(F.col("k").isin(third)), o.weight).items() if no} if third else set()
            out |= in_rounds(big.where("whole"), {k: requests[k] for k in large if k not in biased}, kinds, gaps, o, width)
        return out
    finally:
        counted.unpersist()


def _add(column: str) -> Column:
    return F.sum(column).alias(column)


def in_rounds(counted: DataFrame, requests: dict[int, Request], kinds: dict[str, bool], gaps: set[str], o: Setting, width: int) -> dict[int, dict]:
    """Results of requests of many cells; one job a round for all of them."""
    position = F.posexplode(F.array(*(F.col(f"c{j}") for j in range(width)))).alias("j", "code")
    levels: dict[tuple[int, int], np.ndarray] = {}
    discrete = {(k, j) for k, r in requests.items() for j, s in enumerate(_scales(r, o, gaps, kinds)) if s is None}
    found = counted.select("k", position).distinct().where(F.concat_ws("|", "k", "j").isin([f"{k}|{j}" for k, j in discrete])) if discrete else None
    for (k, j), p in found.toPandas().groupby(["k", "j"]) if found is not None else ():
        levels[int(k), int(j)] = np.sort(p["code"].to_numpy())
    sums = {r["k"]: r["w"] * o.weight for r in counted.groupBy("k").agg(_add("w")).collect()}
    live, out = {}, {}
    for k, r in requests.items():
        scales = [s or Scale(len(levels[k, j])) for j, s in enumerate(_scales(r, o, gaps, kinds))]
        live[k] = begin(Search(scales, sums[k], o.cplx, o.maxbins, o.initbins), r.kind, len(r.columns), o)
    answers: dict[int, list[Table] | None] = dict.fromkeys(live)
    while live:
        asked = {}
        for k, search in list(live.items()):
            try:
                asked[k] = next(search) if answers[k] is None else search.send(answers[k])
            except StopIteration as e:
                out[k] = plain(e.value)
                del live[k]
        if asked:
            answers = _counted(counted, asked, levels, o.weight)
    return out


def _counted(counted: DataFrame, asked: dict[int, list], levels: dict[tuple[int, int], np.ndarray], weight: float) -> dict[int, list[Table]]:
    """The tables that the searches ask for, from one job; cells of one table are named by one number, by its bins in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column("k").to_numpy()
            for k in np.unique(ks).tolist():
                if k not in asked:
                    continue
                part = b.filter(pa.array(ks == k))
                codes = []
                for j in range(part.num_columns - 3):
                    c = part.column(f"c{j}").to_numpy()
                    codes.append(np.searchsorted(levels[k, j], c) if (k, j) in levels else c)
                w, m = part.column("w").to_numpy(), part.column("m").to_numpy()
                for q, (columns, t) in enumerate(zip(asked[k], tables_of(codes, w, m, asked[k]))):
                    number = np.zeros(len(t.w), np.int64)
                    for (_, to), bins in zip(columns, t.bins):
                        number = number * bins_of(to) + bins
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), k), pa.int32()), pa.array(np.full(len(number), q), pa.int32()), pa.array(number), pa.array(t.w), pa.array(t.rows)], ["k", "q", "number", "w", "m"])

    names = [c for c in counted.columns if c not in ("whole", "w", "m", "k")]
    sums = counted.select("k", *names, "w", "m").mapInArrow(run, "k int, q int, number long, w double, m double").groupBy("k", "q", "number").agg(_add("w"), _add("m")).toPandas()
    out: dict[int, list[Table]] = {}
    parts = dict(list(sums.groupby(["k", "q"])))
    for k, tables in asked.items():
        out[k] = []
        for q, columns in enumerate(tables):
            p = parts[k, q].sort_values("number")
            number, bins = p["number"].to_numpy(), []
            for _, to in reversed(columns):
                number, at = np.divmod(number, bins_of(to))
                bins.insert(0, at)
            out[k].append(Table(bins, p["w"].to_numpy() * weight, p["m"].to_numpy()))
    return out

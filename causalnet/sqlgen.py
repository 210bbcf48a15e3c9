"""DuckDB SQL for information measures, to hold the Spark operators against."""

from __future__ import annotations

from collections.abc import Sequence

C2 = (
    "CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} <= 1000 THEN ln(list_sum(list_transform(range(0, ({n})::BIGINT + 1), lambda h: exp(lgamma({n} + 1) - lgamma(h + 1) - lgamma({n} - h + 1) "
    "+ CASE WHEN h > 0 THEN h * ln(h) ELSE 0 END + CASE WHEN {n} - h > 0 THEN ({n} - h) * ln({n} - h) ELSE 0 END - {n} * ln({n}))))) "
    "ELSE 0.5 * ln({n} * pi() / 2) + sqrt(8 / (9 * {n} * pi())) + (3 * pi() - 16) / (36 * {n} * pi()) END"
)


def log_c(n: str, r: str) -> str:
    """log C(n, r); n and r are SQL expressions (r of few levels: the recurrence unfolds as a fold)."""
    c2 = C2.format(n=f"({n})::DOUBLE")
    fold = (
        f"list_reduce(list_concat([{{'q': exp({c2}), 's': {c2}}}], list_transform(range(3, {r} + 1), lambda l: {{'q': l::DOUBLE, 's': 0.0::DOUBLE}})), "
        f"lambda a, b: {{'q': 1 + ({n}) / ((b.q - 2) * a.q), 's': a.s + ln(1 + ({n}) / ((b.q - 2) * a.q))}}).s"
    )
    return f"CASE WHEN ({n}) <= 0 OR {r} <= 1 THEN 0.0 WHEN {r} = 2 THEN {c2} ELSE {fold} END"


def info(base: str, x: str, y: str, given: Sequence[str] = (), cplx: str = "nml", clamp: bool | None = None, weight: str = "1.0") -> str:
    """A SELECT of one row: n, info, cplx, of complete rows of the query ``base``."""
    u = list(given)
    clamp = bool(u) if clamp is None else clamp
    cols = [x, y, *u]
    c = f"(SELECT {', '.join(cols)}, sum({weight}) AS n FROM ({base}) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in cols)} GROUP BY {', '.join(cols)})"

    def part(by: list[str], name: str) -> str:
        keys = [*by, *u]
        return f"(SELECT sum(n) AS n FROM {c}" + (f" GROUP BY {', '.join(keys)}" if keys else "") + f") AS {name}"

    h = lambda by, name: f"(SELECT sum(n * ln(n)) FROM {part(by, name)})"
    lc = lambda by, name, r: f"(SELECT sum({log_c('greatest(1, round(n))', r)}) FROM {part(by, name)}, l)"
    ru = " * ".join(f"count(DISTINCT {k})" for k in u) or "1"
    levels = f"SELECT sum(n) AS total, count(DISTINCT {x}) AS rx, count(DISTINCT {y}) AS ry, {ru} AS ru FROM {c}"
    raw = f"{h([x, y], 'a')} + {h([], 'b')} - {h([x], 'd')} - {h([y], 'e')}"
    k = f"0.5 * ({lc([x], 'a', 'ry')} - {lc([], 'b', 'ry')} + {lc([y], 'd', 'rx')} - {lc([], 'e', 'rx')})" if cplx == "nml" else "0.5 * ln(total) * (rx - 1) * (ry - 1) * ru"
    zero = "rx <= 1 OR ry <= 1"
    q = f"WITH l AS ({levels}) SELECT total AS n, CASE WHEN {zero} OR abs({raw}) < 1e-10 THEN 0.0 ELSE {raw} END AS info, CASE WHEN {zero} THEN 0.0 ELSE {k} END AS cplx FROM l"
    if clamp:
        q = f"SELECT n, CASE WHEN info - cplx < 0 THEN 0.0 ELSE info END AS info, CASE WHEN info - cplx < 0 THEN 0.0 ELSE cplx END AS cplx FROM ({q})"
    return q


def three_point(base: str, x: str, y: str, z: str, given: Sequence[str] = (), cplx: str = "nml") -> str:
    """A SELECT of one row: n, i3, i3k, i2, i2k, score."""
    u = list(given)
    whole = f"SELECT * FROM ({base}) WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in (x, y, z, *u))
    sub = lambda *a: f"({info(whole, *a, cplx, True)})"
    return (
        "SELECT n, i3, i3k, i2, i2k, CASE WHEN abs(s) < 1e-10 THEN 0.0 ELSE s END AS score FROM ("
        "SELECT *, least(i3k, least(xz, yz) - ln(1 + exp(-abs(xz - yz)))) AS s FROM ("
        "SELECT a.n, a.info - b.info AS i3, CASE WHEN abs(a.info - b.info - a.cplx + b.cplx) < 1e-10 THEN 0.0 ELSE a.info - b.info - a.cplx + b.cplx END AS i3k, a.info AS i2, a.info - a.cplx AS i2k, "
        "(c.info - c.cplx) - (a.info - a.cplx) AS xz, (d.info - d.cplx) - (a.info - a.cplx) AS yz "
        f"FROM {sub(x, y, u)} a, {sub(x, y, [*u, z])} b, {sub(x, z, u)} c, {sub(y, z, u)} d))"
    )

"""Information of discrete variables from weighted counts.

Everything is a function of cells: one row per combination of levels that occurs, keyed by request.
``request_cells`` makes the cells of many requests in one pass (explode, then a hash aggregate whose
map side collapses them to the number of level combinations); all later steps touch cells only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalnet.functions.complexity import log_c_col, n_log_n
from causalnet.functions.scores import dpi_score

SMALL = 1e-10


def request_cells(df: DataFrame, requests: Sequence[tuple[str, ...]], weight: str | None = None) -> DataFrame:
    """(k, v0, v1, ..., n): the weighted counts of each request's variables over its complete rows.

    Requests of fewer variables leave the last columns null."""
    width = max(map(len, requests))
    code = lambda c: F.col(c).cast("string")
    rows = [
        F.struct(F.lit(k).alias("k"), F.array(*map(code, r)).alias("v"))
        for k, r in enumerate(requests)
    ]
    own = df.select(F.explode(F.array(*rows)).alias("r"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    own = own.select("r.k", *(F.get("r.v", F.lit(i)).alias(f"v{i}") for i in range(width)), F.exists("r.v", lambda v: v.isNull()).alias("gap"), "w")
    # Persisted: every marginal is made from these few rows, the table is read once.
    return own.where(~F.col("gap")).groupBy("k", *(f"v{i}" for i in range(width))).agg(F.sum("w").alias("n")).persist()


def marginals(cells: DataFrame, own: Sequence[str], given: Sequence[str], cplx: str) -> DataFrame:
    """One row per request, with the sums that all informations among ``own`` given ``given`` are made of.

    total; r0, r1, ... and ru, the levels of each and the product of those of ``given``; for each subset of ``own`` (bit i: the
    i-th) with ``given``: h<bits>, the sum of n ln n over its level combinations, and for NML c<bits>_<j>, that of log C of their
    counts over the levels of the j-th variable outside. One aggregate by grouping sets makes all marginals of the cells."""
    d, u, columns = len(own), list(given), [*own, *given]
    levels = cells.groupBy("k").agg(F.sum("n").alias("total"), *(F.count_distinct(c).alias(f"r{i}") for i, c in enumerate(own)), *(F.count_distinct(c).alias(f"u{i}") for i in range(len(u)) for c in (u[i],)))
    ru = F.lit(1)
    for i in range(len(u)):
        ru = ru * F.col(f"u{i}")
    levels = levels.select("k", "total", *(f"r{i}" for i in range(d)), ru.cast("long").alias("ru"))
    sets = [["k", *(c for i, c in enumerate(own) if bits >> i & 1), *u] for bits in range(1 << d)]
    inside = sum(((1 - F.grouping(c)) * (1 << i) for i, c in enumerate(own)), F.lit(0))
    each = cells.groupingSets([[F.col(c) for c in s] for s in sets], "k", *columns).agg(F.sum("n").alias("n"), inside.alias("bits"))
    each = each.select("k", "bits", "n")
    of = lambda bits, v: F.sum(F.when(F.col("bits") == bits, v))
    sums = [of(bits, n_log_n(F.col("n"))).alias(f"h{bits}") for bits in range(1 << d)]
    if cplx == "nml":
        count = F.greatest(F.lit(1), F.round("n").cast("long"))
        outside = [(bits, j) for bits in range(1 << d) for j in range(d) if not bits >> j & 1 and bits != (1 << d) - 1]
        each = each.join(levels.select("k", *(f"r{i}" for i in range(d))), "k").withColumns({f"l{j}": log_c_col(count, F.col(f"r{j}")) for j in range(d)})
        sums += [of(bits, F.col(f"l{j}")).alias(f"c{bits}_{j}") for bits, j in outside]
    return levels.join(each.groupBy("k").agg(*sums), "k")


def _info(i: int, j: int, with_: int, cplx: str) -> tuple[Column, Column]:
    """Information of the i-th and the j-th variable of ``marginals`` given those of the bits ``with_``, and its complexity."""
    a, b = 1 << i, 1 << j
    h = lambda bits: F.col(f"h{bits | with_}")
    c = lambda bits, v: F.col(f"c{bits | with_}_{v}")
    ri, rj = F.col(f"r{i}"), F.col(f"r{j}")
    info = h(a | b) + h(0) - h(a) - h(b)
    one = (ri <= 1) | (rj <= 1)
    if cplx == "nml":
        k = 0.5 * (c(a, j) - c(0, j) + c(b, i) - c(0, i))
    else:
        ru = F.col("ru")
        for v in range(8):
            if with_ >> v & 1:
                ru = ru * F.col(f"r{v}")
        k = 0.5 * F.log("total") * (ri - 1) * (rj - 1) * ru
    return F.when(one | (F.abs(info) < SMALL), 0.0).otherwise(info), F.when(one, 0.0).otherwise(k)


def conditional_info(cells: DataFrame, x: str, y: str, given: Sequence[str] = (), cplx: str = "nml", negative_info: bool = False, suffix: str = "") -> DataFrame:
    """(k, n, info, cplx) of I(x;y|given), in nats times samples; clamped at zero when conditional."""
    info, k = _info(0, 1, 0, cplx)
    out = marginals(cells, [x, y], given, cplx).select("k", F.col("total").alias(f"n{suffix}"), info.alias("i_"), k.alias("k_"))
    clamp = (F.col("i_") - F.col("k_") < 0) if given and not negative_info else F.lit(False)
    zero = lambda c: F.when(clamp, 0.0).otherwise(F.col(c))
    return out.select("k", f"n{suffix}", zero("i_").alias(f"info{suffix}"), zero("k_").alias(f"cplx{suffix}"))


def three_point(cells: DataFrame, x: str = "v0", y: str = "v1", z: str = "v2", given: Sequence[str] = (), cplx: str = "nml") -> DataFrame:
    """(k, n, i3, i3k, i2, i2k, score): I(x;y;z|given), I(x;y|given) and the contribution score of z.

    i3k and i2k are shifted by their complexity."""
    terms = {"xy": _info(0, 1, 0, cplx), "xyz": _info(0, 1, 4, cplx), "xz": _info(0, 2, 0, cplx), "yz": _info(1, 2, 0, cplx)}
    a = marginals(cells, [x, y, z], given, cplx).select("k", F.col("total").alias("n"), *(c.alias(f"{n}_{name}") for name, (i, k) in terms.items() for n, c in (("info", i), ("cplx", k))))

    def clamped(name: str) -> tuple[Column, Column]:
        i, k = F.col(f"info_{name}"), F.col(f"cplx_{name}")
        low = i - k < 0
        return F.when(low, 0.0).otherwise(i), F.when(low, 0.0).otherwise(k)

    (i_xy, k_xy), (i_xyz, k_xyz), (i_xz, k_xz), (i_yz, k_yz) = map(clamped, ("xy", "xyz", "xz", "yz"))
    i3, k3 = i_xy - i_xyz, k_xy - k_xyz
    i3k = F.when(F.abs(i3 - k3) < SMALL, 0.0).otherwise(i3 - k3)
    xz, yz = (i_xz - k_xz) - (i_xy - k_xy), (i_yz - k_yz) - (i_xy - k_xy)
    score = dpi_score(i3k, xz, yz)
    return a.select("k", "n", i3.alias("i3"), i3k.alias("i3k"), i_xy.alias("i2"), (i_xy - k_xy).alias("i2k"), F.when(F.abs(score) < SMALL, 0.0).otherwise(score).alias("score"))


def named(result: DataFrame, requests: Sequence[tuple[str, ...]], names: Sequence[str]) -> DataFrame:
    """Replace k by the request's variable names: a join with a table of one row per request."""
    spark = result.sparkSession
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(requests)], "k int, " + ", ".join(f"{n} string" for n in names))
    return table.join(result, "k").drop("k")


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    c = list(columns)
    return [(c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c))]


def pairwise_info(df: DataFrame, columns: Sequence[str], cplx: str = "nml", weight: str | None = None) -> DataFrame:
    """(x, y, n, info, cplx, info_shifted) of every pair, from one scan."""
    requests = all_pairs(columns)
    r = conditional_info(request_cells(df, requests, weight), "v0", "v1", (), cplx)
    return named(r, requests, ("x", "y")).withColumn("info_shifted", F.col("info") - F.col("cplx"))


def mutual_info(df: DataFrame, x: str, y: str, given: Sequence[str] = (), cplx: str = "nml", weight: str | None = None, negative_info: bool = False) -> DataFrame:
    cells = request_cells(df, [(x, y, *given)], weight)
    r = conditional_info(cells, "v0", "v1", [f"v{i + 2}" for i in range(len(given))], cplx, negative_info)
    return r.drop("k").withColumn("info_shifted", F.col("info") - F.col("cplx"))


def three_point_info(df: DataFrame, x: str, y: str, z: str, given: Sequence[str] = (), cplx: str = "nml", weight: str | None = None) -> DataFrame:
    cells = request_cells(df, [(x, y, z, *given)], weight)
    return three_point(cells, given=[f"v{i + 3}" for i in range(len(given))], cplx=cplx).drop("k")


def contributors(df: DataFrame, edges: Sequence[tuple[str, str]], others: Sequence[str], cplx: str = "nml") -> DataFrame:
    """(x, y, z, i3, i3k, i2, i2k, score) for every edge and every other variable."""
    requests = [(x, y, z) for x, y in edges for z in others if z not in (x, y)]
    return named(three_point(request_cells(df, requests), cplx=cplx), requests, ("x", "y", "z"))


def best_contributor(scores: DataFrame) -> DataFrame:
    """The z of highest positive score of each edge; ties go to the first name.

    Scores are read once: their last bits follow the order of sums, so a second evaluation need not equal the first."""
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("score"), "z"))
    return scores.where("score > 0").withColumn("place_", place).where("place_ = 1").select("x", "y", "score", "z")


def entropies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, levels, entropy): the entropy in nats of each column's known values, from one scan."""
    requests = [(c,) for c in columns]
    cells = request_cells(df, requests)
    r = cells.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels"), F.sum(n_log_n(F.col("n"))).alias("s"))
    r = r.select("k", "n", "levels", (F.log("n") - F.col("s") / F.col("n")).alias("entropy"))
    return named(r, requests, ("variable",))


def kl_missing_at_random(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """n sum p ln(p/q) of (x, y): p over rows that also know z, q over rows that know x and y."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("q"), F.count(z).alias("p"))
    total = cells.agg(F.sum("q").alias("nq"), F.sum("p").alias("n"), F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.col("q")))).alias("s"))
    kl = F.coalesce("s", F.lit(0.0)) + F.col("n") * F.log(F.col("nq") / F.col("n"))
    return total.select("n", kl.alias("kl"), F.log("n").alias("penalty"), (kl - F.log("n") > 0).alias("rejected"))

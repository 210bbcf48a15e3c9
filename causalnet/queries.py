"""The query catalogue: one query per operator, with DuckDB SQL where SQL expresses it.

Doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalnet import sqlgen
from causalnet.functions import complexity, scores
from causalnet.operators import discrete, encode, graph, neighbours, network, standalone, summary, temporal
from causalnet.sources import observations, sinks
from causalnet.sources.observations import Variable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LINE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]
ORDERED = "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"
# A graph of regions, nations and suppliers: suppliers in debt also stand beside their region, which closes triangles.
EDGES_SQL = (
    "(SELECT r_name AS x, n_name AS y FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey UNION ALL "
    "SELECT s_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal < 0) AS e(x, y)"
)
# Edges between lagged variables, named after levels of order lines.
LAGGED_SQL = (
    "(SELECT l_linestatus || '_lag' || (l_linenumber % 3) AS x, o_orderstatus || '_lag' || (l_orderkey % 2) AS y, sum(l_quantity) / 1000 AS info_shifted "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) AS e(x, y, info_shifted)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits; no negative zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c, t in df.dtypes if t == "double"})


def r6_sql(q: str, doubles: str, others: str = "") -> str:
    return f"SELECT {others + ', ' if others else ''}{', '.join(f'round({c.strip()}, 6) + 0.0 AS {c.strip()}' for c in doubles.split(','))} FROM ({q})"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def edges(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    of_region = nation.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    of_supplier = of_region.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    all_of = of_region.select(F.col("r_name").alias("x"), F.col("n_name").alias("y")).unionByName(of_supplier.select(F.col("n_name").alias("x"), F.col("s_name").alias("y")))
    return all_of.unionByName(of_supplier.where("s_acctbal < 0").select(F.col("s_name").alias("x"), F.col("r_name").alias("y")))


def lagged(spark: SparkSession, d: str) -> DataFrame:
    name = lambda v, k: F.concat(F.col(v), F.lit("_lag"), k.cast("string"))
    both = lines_and_orders(spark, d)
    return both.groupBy(name("l_linestatus", F.col("l_linenumber") % 3).alias("x"), name("o_orderstatus", F.col("l_orderkey") % 2).alias("y")).agg((F.sum("l_quantity") / 1000).alias("info_shifted"))


# Sources and checks

@query("profile_variables", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n_known, count(DISTINCT {c}) AS n_distinct, {str(c in ('doc_id', 'n_chars', 'quality', 'toxic')).lower()} AS is_numeric, {str(c in ('doc_id', 'n_chars', 'quality', 'toxic')).lower()} AND count(DISTINCT {c}) >= 5 AS is_continuous FROM ({ORDERED})" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def _profile(spark, d):
    return observations.profile(labelled(spark, d))


@query("drop_all_null_cols_rows", "SELECT quality, toxic FROM (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def _drop(spark, d):
    return observations.check_observations(labelled(spark, d).select("quality", "toxic", F.lit(None).cast("string").alias("none")))


@query("pair_list_canonical", "SELECT DISTINCT least(l_returnflag, o_orderstatus) AS var1, greatest(l_returnflag, o_orderstatus) AS var2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> o_orderstatus")
def _pairs(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return observations.canonical_pairs(j.select(F.col("l_returnflag").alias("var1"), F.col("o_orderstatus").alias("var2")))


_BLACK_SQL = "(SELECT s_name AS var1, n_name AS var2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)"


@query("black_box_filter", f"SELECT x, y FROM {EDGES_SQL} WHERE NOT EXISTS (SELECT 1 FROM {_BLACK_SQL} b WHERE least(e.x, e.y) = least(var1, var2) AND greatest(e.x, e.y) = greatest(var1, var2))")
def _black(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return observations.without_pairs(edges(spark, d), rich.select(F.col("s_name").alias("var1"), F.col("n_name").alias("var2")))


@query("encode_codes", "SELECT level, n, (dense_rank() OVER (ORDER BY level) - 1)::INTEGER AS code FROM (SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1)")
def _codes(spark, d):
    return encode.level_codes(table(spark, d, "orders"), "o_orderpriority")


_PAIRS = [("quality", "lang"), ("quality", "source"), ("lang", "source"), ("quality", "toxic")]


@query("complete_case_counts", " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count_if({x} IS NOT NULL AND {y} IS NOT NULL)::BIGINT AS n FROM ({ORDERED})" for x, y in _PAIRS))
def _complete(spark, d):
    return observations.complete_case_counts(labelled(spark, d), _PAIRS)


_BINS = 8
_EQUAL = (
    "WITH v AS (SELECT n_chars AS value, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1), p AS (SELECT value, n, sum(n) OVER (ORDER BY value) - n AS before, sum(n) OVER () AS total, row_number() OVER (ORDER BY value) AS j FROM v), "
    f"q AS (SELECT value, n, j, least(floor(before / greatest(floor(total / {_BINS}), 1)), {_BINS - 1}) AS raw FROM p) SELECT value, n, (j + min(raw - j) OVER (ORDER BY value))::INTEGER AS bin FROM q"
)


@query("equal_freq_bins", _EQUAL)
def _equal(spark, d):
    return encode.equal_frequency(table(spark, d, "documents"), "n_chars", _BINS)


# Discrete information

@query("entropy_by_column", r6_sql(" UNION ALL ".join(f"SELECT '{c}' AS variable, sum(n)::DOUBLE AS n, count(*) AS levels, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1)" for c in LINE), "n, entropy", "variable, levels"))
def _entropy(spark, d):
    return r6(discrete.entropies(table(spark, d, "lineitem"), LINE))


_L = "SELECT * FROM lineitem"
_LO = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _shifted(q: str) -> str:
    return f"SELECT *, info - cplx AS info_shifted FROM ({q})"


def lines_and_orders(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


for _c in ("bic", "nml"):
    _one = "n, info, cplx, info_shifted"

    @query(f"mi_pair_{_c}", r6_sql(_shifted(sqlgen.info(_L, "l_returnflag", "l_linestatus", cplx=_c)), _one))
    def _mi(spark, d, c=_c):
        return r6(discrete.mutual_info(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", cplx=c))

    @query(f"mi_all_pairs_{_c}", r6_sql(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, * FROM ({_shifted(sqlgen.info(_L, x, y, cplx=_c))})" for x, y in discrete.all_pairs(LINE)), _one, "x, y"))
    def _all(spark, d, c=_c):
        return r6(discrete.pairwise_info(table(spark, d, "lineitem"), LINE, c))

    @query(f"cmi_{_c}", r6_sql(_shifted(sqlgen.info(_L, "l_returnflag", "l_linestatus", ["l_tax"], _c)), _one))
    def _cmi(spark, d, c=_c):
        return r6(discrete.mutual_info(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["l_tax"], c))

    @query(f"cmi2_{_c}", r6_sql(_shifted(sqlgen.info(_LO, "l_returnflag", "o_orderstatus", ["l_linestatus", "l_tax"], _c)), _one))
    def _cmi2(spark, d, c=_c):
        return r6(discrete.mutual_info(lines_and_orders(spark, d), "l_returnflag", "o_orderstatus", ["l_linestatus", "l_tax"], c))

    @query(f"three_point_{_c}", r6_sql(sqlgen.three_point(_L, "l_returnflag", "l_linestatus", "l_linenumber", cplx=_c), "n, i3, i3k, i2, i2k, score"))
    def _three(spark, d, c=_c):
        return r6(discrete.three_point_info(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber", cplx=c))

    @query(f"three_point_given_{_c}", r6_sql(sqlgen.three_point(_L, "l_returnflag", "l_linestatus", "l_linenumber", ["l_tax"], _c), "n, i3, i3k, i2, i2k, score"))
    def _three_u(spark, d, c=_c):
        return r6(discrete.three_point_info(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber", ["l_tax"], c))


@query("mi_sample_weights_bic", r6_sql("SELECT n, info, info - cplx AS infok FROM (" + sqlgen.info(_L, "l_returnflag", "l_linestatus", cplx="bic", weight="l_discount") + ")", "n, info, infok"))
def _sample_weights(spark, d):
    one = standalone.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", cplx="bic", sample_weights="l_discount")
    return r6(one.select("n", "info", "infok"))


@query("mi_weighted_neff", r6_sql(_shifted(sqlgen.info(_L, "l_returnflag", "l_linestatus", cplx="nml", weight="0.1")), "n, info, cplx, info_shifted"))
def _weighted(spark, d):
    return r6(discrete.mutual_info(table(spark, d, "lineitem").withColumn("w", F.lit(0.1)), "l_returnflag", "l_linestatus", weight="w"))


@query("mi_with_nulls", r6_sql(_shifted(sqlgen.info(ORDERED, "quality", "lang", cplx="nml")), "n, info, cplx, info_shifted"))
def _nulls(spark, d):
    return r6(discrete.mutual_info(labelled(spark, d), "quality", "lang"))


_E2 = [("l_returnflag", "l_linestatus"), ("l_linenumber", "l_tax")]
_BEST = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, '{z}' AS z, score FROM ({sqlgen.three_point(_LO, x, y, z, cplx='bic')})" for x, y in _E2 for z in [*LINE, "o_orderstatus"] if z not in (x, y))


@query("contributor_scores", r6_sql(_BEST, "score", "x, y, z"))
def _contributors(spark, d):
    return r6(discrete.contributors(lines_and_orders(spark, d), _E2, [*LINE, "o_orderstatus"], "bic").select("x", "y", "z", "score"))


_STEPS = "SELECT floor(l_quantity / 5) AS fine, floor(l_quantity / 10) AS middle, floor(l_quantity / 20) AS coarse, l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem"
_E3 = [("fine", "coarse"), ("l_returnflag", "l_linestatus")]
_Z3 = ["middle", "l_linenumber", "l_tax"]
_MEDIATED = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, '{z}' AS z, score FROM ({sqlgen.three_point(_STEPS, x, y, z, cplx='bic')})" for x, y in _E3 for z in _Z3)


@query("best_contributor", r6_sql(f"SELECT x, y, z, score FROM ({_MEDIATED}) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY score DESC, z) = 1", "score", "x, y, z"))
def _best(spark, d):
    line = table(spark, d, "lineitem")
    steps = line.select(*(F.floor(F.col("l_quantity") / k).alias(c) for c, k in (("fine", 5), ("middle", 10), ("coarse", 20))), "l_returnflag", "l_linestatus", "l_linenumber", "l_tax")
    return r6(discrete.best_contributor(discrete.contributors(steps, _E3, _Z3, "bic"))).select("x", "y", "z", "score")


@query("kl_mar_discrete", r6_sql("WITH c AS (SELECT lang, source, count(*) AS q, count(quality) AS p FROM (" + ORDERED + ") GROUP BY 1, 2), t AS (SELECT sum(q) AS nq, sum(p) AS n FROM c) SELECT n::DOUBLE AS n, sum(CASE WHEN p > 0 THEN p * ln((p / n) / (q / nq)) ELSE 0 END) AS kl, ln(n) AS penalty, sum(CASE WHEN p > 0 THEN p * ln((p / n) / (q / nq)) ELSE 0 END) - ln(n) > 0 AS rejected FROM c, t GROUP BY n", "n, kl, penalty", "rejected"))
def _kl(spark, d):
    return r6(discrete.kl_missing_at_random(labelled(spark, d), "lang", "source", "quality").withColumn("n", F.col("n").cast("double")))


@query("logc_table", "SELECT key, n, r, round(" + sqlgen.log_c("n", "r") + ", 6) AS log_c FROM (SELECT 's' || l_suppkey AS key, count(*) AS n, count(DISTINCT l_linenumber) AS r FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, count(*), count(DISTINCT l_linestatus) FROM lineitem GROUP BY 1 UNION ALL SELECT 'o' || l_orderkey, count(*), count(DISTINCT l_returnflag) FROM lineitem GROUP BY 1)")
def _logc(spark, d):
    line = table(spark, d, "lineitem")
    count = lambda key, r: line.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(r).alias("r"))
    groups = count(F.concat(F.lit("s"), "l_suppkey"), "l_linenumber").unionByName(count(F.col("l_returnflag"), "l_linestatus")).unionByName(count(F.concat(F.lit("o"), "l_orderkey"), "l_returnflag"))
    return r6(groups.withColumn("log_c", complexity.log_c_col(F.col("n"), F.col("r"))))


# Whether gaps fall at random, where variables are continuous

def _knn_sql(groups: str, d: int) -> str:
    """(k, n1, n2, kl) of points (k, x, y, known), by all distances to the 5th neighbour."""
    u = lambda c, salt: f"{c} + (('0x' || substr(md5('{salt}|' || x || '|' || {'y' if d > 1 else chr(39) * 2} || '|' || copy), 1, 8))::BIGINT / 2147483648.0 - 1) * greatest({neighbours.NOISE}, abs({c}) * 1e-10)"
    far = "sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2)"
    fifth = lambda where: f"(SELECT k, i, list_sort(list({far.replace('a.', 'a.').replace('b.', 'b.')}))[{neighbours.K}] AS r FROM p a JOIN (SELECT k AS bk, px, py, known AS bknown FROM p) b ON a.k = bk {where} WHERE a.known GROUP BY 1, 2)"
    return (
        f"WITH g AS ({groups}), c AS (SELECT *, row_number() OVER (PARTITION BY k, x{', y' if d > 1 else ''} ORDER BY known DESC) - 1 AS copy FROM g), "
        f"p AS MATERIALIZED (SELECT k, known, row_number() OVER () AS i, {u('x', 0)} AS px, {u('y', 1) if d > 1 else '0.0'} AS py FROM c), "
        f"n AS (SELECT k, count_if(known) AS n1, count(*) AS n2 FROM p GROUP BY 1), "
        f"s AS (SELECT k, sum(ln(a.r / b.r)) AS s FROM {fifth('')} a JOIN {fifth('AND bknown')} b USING (k, i) GROUP BY 1) "
        f"SELECT k, n1, n2, CASE WHEN n1 > {neighbours.K} THEN {d} * s + n1 * ln((n2 - 1) / (n1 - 1)) END AS kl FROM n LEFT JOIN s USING (k)"
    )


_PLACES = ORDERED.replace("SELECT doc_id", "SELECT doc_id::DOUBLE AS x, n_chars::DOUBLE AS y, lang AS level, quality IS NOT NULL AS known, doc_id")
_VERDICT = "n1::DOUBLE AS n, round(kl, 6) + 0.0 AS kl, round(ln(n1), 6) AS penalty, kl > ln(n1) AS rejected"


@query("kl_mar_continuous", f"SELECT {_VERDICT} FROM ({_knn_sql(f'SELECT 1 AS k, x, y, known FROM ({_PLACES})', 2)})")
def _kl_continuous(spark, d):
    return r6(neighbours.kl_missing_at_random(labelled(spark, d), "doc_id", "n_chars", "quality", continuous=["doc_id", "n_chars"]))


@query("kl_mar_mixed", f"SELECT {_VERDICT} FROM (SELECT sum(n1)::BIGINT AS n1, sum(greatest(0, coalesce(kl, 0)) + CASE WHEN n1 > 0 THEN n1 * ln(n1 / t1 * t2 / n2) ELSE 0 END) AS kl FROM (SELECT *, sum(n1) OVER () AS t1, sum(n2) OVER () AS t2 FROM ({_knn_sql(f'SELECT level AS k, y AS x, 0.0 AS y, known FROM ({_PLACES})', 1)})))")
def _kl_mixed(spark, d):
    return r6(neighbours.kl_missing_at_random(labelled(spark, d), "lang", "n_chars", "quality", continuous=["n_chars"]))


_EF = _EQUAL.replace("SELECT value, n, (j", "SELECT value, (j")


@query("mi_equal_freq", r6_sql(_shifted(sqlgen.info(f"SELECT bin, lang FROM documents JOIN ({_EF}) ON n_chars = value", "bin", "lang", cplx="nml")), "n, info, cplx, info_shifted"))
def _mi_bins(spark, d):
    return r6(discrete.mutual_info(encode.with_bins(table(spark, d, "documents"), "n_chars", _BINS, "bin"), "bin", "lang"))


# Continuous and mixed information: iterative, so tests hold them against brute force

def noisy_sizes(spark, d) -> DataFrame:
    """Sizes of parts, a noisy copy of them, and the class that both depend on."""
    p = table(spark, d, "part")
    return p.select("p_size", (F.col("p_size") + F.col("p_partkey") % 9).cast("double").alias("noisy"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("class"))


@query("mi_continuous")
def _mi_cont(spark, d):
    return r6(standalone.mutual_information(noisy_sizes(spark, d), "p_size", "noisy"))


@query("mi_mixed")
def _mi_mixed(spark, d):
    return r6(standalone.mutual_information(noisy_sizes(spark, d), "class", "noisy"))


@query("cmi_continuous")
def _cmi_cont(spark, d):
    return r6(standalone.mutual_information(noisy_sizes(spark, d), "p_size", "noisy", ["class"]))


@query("three_point_mixed")
def _three_mixed(spark, d):
    return r6(standalone.three_point_information(noisy_sizes(spark, d), "p_size", "noisy", "class"))


@query("discretize_mutual_cutpoints")
def _cutpoints(spark, d):
    line = table(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") * 3 + F.col("l_orderkey") % 11).alias("noisy"))
    return r6(standalone.discretise_mutual(line, "l_quantity", "noisy"))


@query("discretize_mdl")
def _mdl(spark, d):
    return r6(standalone.discretise_mdl(table(spark, d, "supplier").select((F.col("s_acctbal") + F.col("s_suppkey") % 2 * 100_000).alias("two")), "two"))


@query("bin_density", "SELECT (CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END)::INTEGER AS bin_x, (CASE WHEN hi THEN 2 ELSE 1 END)::INTEGER AS bin_y, count(*) AS n, round(count(*) / sum(count(*)) OVER () / (25.0 * CASE WHEN hi THEN 0.06 ELSE 0.05 END), 6) AS density FROM (SELECT l_quantity, l_tax, l_tax > 0.04 AS hi FROM lineitem WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL) GROUP BY 1, 2, hi")
def _density(spark, d):
    return r6(standalone.bin_density(table(spark, d, "lineitem"), "l_quantity", "l_tax", [0.0, 25.0, 50.0], [-0.01, 0.04, 0.1]))


# Network

def observation_table(spark, d) -> DataFrame:
    """Joined variables with derived ones, so that some pairs are truly related."""
    j = lines_and_orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        "l_returnflag", "l_linestatus", "l_linenumber", F.floor(F.col("l_quantity") / 10).cast("string").alias("quantity_bin"), F.floor(F.col("l_extendedprice") / 20000).cast("string").alias("price_bin"),
        F.when(F.floor(F.col("l_quantity") / 10) + F.floor(F.col("l_extendedprice") / 20000) > 3, "large").otherwise("small").alias("size_class"), "l_discount", "l_tax", "o_orderstatus", "o_orderpriority", "c_mktsegment",
    ).withColumn("l_linenumber", F.col("l_linenumber").cast("string"))


@query("reconstruct_network")
def reconstruct_network(spark, d):
    r = network.reconstruct(observation_table(spark, d), [Variable("l_discount", False), Variable("l_tax", False)])
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 6).cast("string")), ",")
    return r6(r.edges.withColumns({"ai": F.array_join("ai", ","), "raw_contributions": text("raw_contributions"), "contributions": text("contributions")}))


@query("network_summary")
def _summary(spark, d):
    cols = ["l_returnflag", "l_linestatus", "quantity_bin", "price_bin", "size_class"]
    return r6(network.reconstruct(observation_table(spark, d).select(*cols), cplx="bic").summary)


@query("network_mixed")
def _mixed(spark, d):
    df = table(spark, d, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    return r6(network.reconstruct(df).edges.select("x", "y", "n", "info", "cplx", "info_shifted", "connected", "ort_inferred"))


_SK = ["l_returnflag", "l_linestatus", "l_linenumber", "o_orderstatus"]


@query("skeleton_bic", r6_sql(" UNION ALL ".join(f"SELECT '{min(x, y)}' AS x, '{max(x, y)}' AS y, n, info, cplx, info - cplx > 0 AS linked FROM ({sqlgen.info(_LO, x, y, cplx='bic')})" for x, y in discrete.all_pairs(_SK)), "n, info, cplx", "x, y, linked"))
def _skeleton(spark, d):
    e = network.reconstruct(lines_and_orders(spark, d).select(*(F.col(c).cast("string").alias(c) for c in _SK)), cplx="bic").edges
    return r6(e.select("x", "y", F.round("n").alias("n"), "info", "cplx", (F.col("info") - F.col("cplx") > 0).alias("linked")))


@query("permutation_confidence")
def _confidence(spark, d):
    cols = ["quantity_bin", "price_bin", "size_class", "l_tax"]
    r = network.reconstruct(observation_table(spark, d).select(*cols), [Variable("l_tax", False)], n_shuffles=5, conf_threshold=0.01)
    return r6(r.edges.select("x", "y", "connected", "confidence"))


@query("consistent_consensus")
def _consistent(spark, d):
    cols = ["l_returnflag", "l_linestatus", "quantity_bin", "price_bin", "size_class"]
    return graph.edge_statistics(network.reconstruct(observation_table(spark, d).select(*cols), consistent="orientation").history)


_NEAR = f"SELECT x AS a, y AS z FROM {EDGES_SQL} UNION SELECT y, x FROM {EDGES_SQL}"
_TRIPLES = f"WITH n AS ({_NEAR}) SELECT p.a AS x, p.z, q.a AS y FROM n p JOIN n q ON p.z = q.z AND p.a < q.a WHERE NOT EXISTS (SELECT 1 FROM n r WHERE r.a = p.a AND r.z = q.a)"


@query("unshielded_triples", _TRIPLES)
def _triples(spark, d):
    return graph.unshielded_triples(edges(spark, d))


@query("edges_outside_triples", f"SELECT x, y FROM {EDGES_SQL} WHERE NOT EXISTS (SELECT 1 FROM ({_TRIPLES}) t WHERE (least(e.x, e.y) = least(t.x, t.z) AND greatest(e.x, e.y) = greatest(t.x, t.z)) OR (least(e.x, e.y) = least(t.y, t.z) AND greatest(e.x, e.y) = greatest(t.y, t.z)))")
def _outside(spark, d):
    return graph.edges_outside_triples(edges(spark, d))


@query("vstructure_score", "SELECT l_orderkey, l_linenumber, round(-i3 - ln(2) + ln(1 + exp(i3)), 6) AS s, round(1 / (1 + exp(-(-i3 - ln(2) + ln(1 + exp(i3))))), 6) AS p FROM (SELECT l_orderkey, l_linenumber, -l_quantity / 4 AS i3 FROM lineitem)")
def _v(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_quantity") / 4).alias("i3"))
    return r6(i.withColumn("s", scores.v_structure_score(F.col("i3"))).withColumn("p", scores.logistic(F.col("s")))).drop("i3")


@query("induced_score", "SELECT l_orderkey, l_linenumber, round(least(abs(i3), w) - ln(1 + exp(least(abs(i3), w) - greatest(abs(i3), w)) + exp(-greatest(abs(i3), w))), 6) AS s FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 4 AS i3, l_extendedprice / 10000 AS w FROM lineitem)")
def _induced(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 4).alias("i3"), (F.col("l_extendedprice") / 10000).alias("w"))
    return r6(i.withColumn("s", scores.induced_score(F.col("i3"), F.col("w")))).drop("i3", "w")


_TIPS = "SELECT l_returnflag AS edge, l_linestatus AS node, round(l_discount * 10, 2) AS p FROM lineitem"


@query("merge_tip_probability", f"SELECT edge, node, round(p, 6) AS p FROM ({_TIPS}) QUALIFY row_number() OVER (PARTITION BY edge, node ORDER BY round(abs(p - 0.5), 12) DESC, p DESC) = 1")
def _tips(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("edge"), F.col("l_linestatus").alias("node"), F.round(F.col("l_discount") * 10, 2).alias("p"))
    return r6(graph.merged_tips(t, "edge", "node"))


_P = "SELECT DISTINCT l_discount * 10 AS p_x, l_tax * 12 AS p_y FROM lineitem"
_TIP = lambda p: f"CASE WHEN {p} > 0 AND (1 - {p}) / {p} < 0.8 THEN 2 ELSE 1 END"
_ADJ = f"SELECT p_x, p_y, {_TIP('p_x')} AS tip_x, {_TIP('p_y')} AS tip_y FROM ({_P})"
_ADJ = f"SELECT *, CASE WHEN tip_x = 2 AND tip_y = 2 THEN 6 WHEN tip_y = 2 THEN 2 WHEN tip_x = 2 THEN -2 ELSE 1 END AS adj FROM ({_ADJ})"


def tip_table(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p_x"), (F.col("l_tax") * 12).alias("p_y")).distinct()


@query("accept_tips_adjacency", r6_sql(_ADJ, "p_x, p_y", "tip_x, tip_y, adj"))
def _accept(spark, d):
    return r6(graph.with_adjacency(tip_table(spark, d), 0.8))


_ONE = lambda h, t: f"coalesce((1 - {h}) / nullif({h}, 0) < 0.8 AND {t} / nullif(1 - {t}, 0) < 0.8, false)"


@query("genuine_cause_flags", r6_sql(f"SELECT *, CASE WHEN adj = 2 THEN {_ONE('p_y', 'p_x')} WHEN adj = -2 THEN {_ONE('p_x', 'p_y')} ELSE false END AS is_causal FROM ({_ADJ})", "p_x, p_y", "tip_x, tip_y, adj, is_causal"))
def _causal(spark, d):
    return r6(graph.genuine_causes(graph.with_adjacency(tip_table(spark, d), 0.8), 0.8))


_HIST = "SELECT l_returnflag AS x, l_linestatus AS y, l_orderkey AS iteration, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -2 END AS adj FROM lineitem"


@query("consensus_and_edge_stats", f"WITH h AS ({_HIST}), c AS (SELECT x, y, adj, count(*) AS c, sum(count(*)) OVER (PARTITION BY x, y) AS total FROM h GROUP BY 1, 2, 3) SELECT x, y, string_agg(round(100 * c / total)::INTEGER || '%(' || adj || ')', ';' ORDER BY c DESC, adj) AS edge_stats, coalesce(max(CASE WHEN adj = 0 THEN c / total END), 0) < 1 - 0.8 AS connected FROM c GROUP BY 1, 2")
def _stats(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.col("l_orderkey").alias("iteration"), F.expr("CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -2 END").alias("adj"))
    return graph.edge_statistics(h)


@query("average_probability", "SELECT l_returnflag AS x, l_linestatus AS y, round(avg(CASE WHEN l_tax > 0 THEN l_tax * 10 END), 6) AS p FROM lineitem GROUP BY 1, 2")
def _average(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 10).otherwise(-1.0).alias("p"))
    return r6(graph.average_probability(h))


_TRUTH_SQL = "(SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 UNION ALL SELECT r_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 9000) AS t(x, y)"


@query("truth_scores", f"WITH f AS (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM {EDGES_SQL}), t AS (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM {_TRUTH_SQL}), c AS (SELECT count_if(f.x IS NOT NULL AND t.x IS NOT NULL)::BIGINT AS tp, count_if(t.x IS NULL)::BIGINT AS fp, count_if(f.x IS NULL)::BIGINT AS fn FROM f FULL JOIN t ON f.x = t.x AND f.y = t.y) SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS fscore FROM c")
def _truth(spark, d):
    of = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    truth = of.where("s_acctbal > 0").select(F.col("s_name").alias("x"), F.col("n_name").alias("y")).unionByName(of.where("s_acctbal > 9000").select(F.col("r_name").alias("x"), F.col("s_name").alias("y")))
    return graph.truth_scores(edges(spark, d), truth)


@query("node_degree", f"SELECT node, count(*) AS degree FROM (SELECT x AS node FROM {EDGES_SQL} UNION ALL SELECT y FROM {EDGES_SQL}) GROUP BY 1")
def _degree(spark, d):
    return graph.node_degree(edges(spark, d))


@query("multi_edge_count", "SELECT least(l_returnflag, o_orderstatus) AS x, greatest(l_returnflag, o_orderstatus) AS y, count(*) AS n_edges FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) > 1")
def _multi(spark, d):
    return graph.multi_edges(lines_and_orders(spark, d).select(F.col("l_returnflag").alias("x"), F.col("o_orderstatus").alias("y")))


@query("graph_reachability", f"WITH RECURSIVE n AS ({_NEAR}), r AS (SELECT min(r_name) AS node FROM region UNION SELECT n.z FROM r JOIN n ON n.a = r.node) SELECT node FROM r")
def _reach(spark, d):
    return graph.reachable(edges(spark, d), table(spark, d, "region").agg(F.min("r_name")).collect()[0][0])


_ENDS = "SELECT r_name AS x, n_name AS y FROM region JOIN nation ON r_regionkey = n_regionkey"


@query("block_path_candidates", f"WITH RECURSIVE n AS ({_NEAR}), p AS (SELECT x, y, [x] AS nodes, x AS here FROM ({_ENDS}) UNION ALL SELECT p.x, p.y, list_append(nodes, n.z), n.z FROM p JOIN n ON n.a = p.here WHERE p.here <> p.y AND NOT list_contains(nodes, n.z)) SELECT e.x, e.y, coalesce(string_agg(DISTINCT b, ',' ORDER BY b), '') AS between FROM ({_ENDS}) e LEFT JOIN (SELECT x, y, unnest(nodes) AS b FROM p WHERE here = y) u ON u.x = e.x AND u.y = e.y AND b <> e.x AND b <> e.y GROUP BY 1, 2")
def _blocks(spark, d):
    ends = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("x"), F.col("n_name").alias("y"))
    return graph.path_candidates(edges(spark, d), ends)


_HEADS = "SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, l_tax * 12.5 AS q FROM lineitem"


@query("consensus_orientation", f"SELECT l_orderkey, l_linenumber, CASE WHEN a AND b THEN 6 WHEN b THEN 2 WHEN a THEN -2 ELSE 1 END AS ort_consensus, (b AND NOT a AND p / nullif(1 - p, 0) < 0.3) OR (a AND NOT b AND q / nullif(1 - q, 0) < 0.3) AS is_causal_consensus FROM (SELECT *, coalesce((1 - p) / nullif(p, 0) < 0.3, false) AS a, coalesce((1 - q) / nullif(q, 0) < 0.3, false) AS b FROM ({_HEADS}))")
def _consensus(spark, d):
    heads = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("p_y2x"), (F.col("l_tax") * 12.5).alias("p_x2y"))
    return graph.consensus_orientation(heads, 0.3).drop("p_y2x", "p_x2y")


# Correlation

_RANK = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@query("spearman_pair", f"SELECT round(corr(a, b), 6) AS rho, CASE WHEN corr(a, b) >= 0 THEN '+' ELSE '-' END AS sign FROM (SELECT {_RANK('l_quantity')} AS a, {_RANK('l_extendedprice')} AS b FROM lineitem)")
def _spearman(spark, d):
    return r6(summary.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("partial_spearman_1", f"WITH r AS (SELECT {_RANK('l_quantity')} AS a, {_RANK('l_extendedprice')} AS b, {_RANK('l_discount')} AS c FROM lineitem), k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS rho FROM k")
def _partial(spark, d):
    rho = summary.partial_spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_discount"])
    return r6(spark.createDataFrame([(rho,)], "rho double"))


# Time

_EV = "SELECT user_id, event_id, hour(ts) AS step, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events"


def events(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.hour("ts").alias("step"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("t"))


@query("trajectories_split", f"WITH e AS ({_EV}), c AS (SELECT *, CASE WHEN lag(step) OVER (PARTITION BY user_id ORDER BY t) > step THEN 1 ELSE 0 END AS cut FROM e), k AS (SELECT *, (sum(cut) OVER (PARTITION BY user_id ORDER BY t))::INTEGER AS traj_id FROM c) SELECT user_id, event_id, traj_id, (row_number() OVER (PARTITION BY user_id, traj_id ORDER BY t))::INTEGER AS time FROM k")
def _split(spark, d):
    return temporal.split_trajectories(events(spark, d), "t", "step", ["user_id"], time="time").select("user_id", "event_id", "traj_id", "time")


_ODD = f"SELECT *, lead(step) OVER (PARTITION BY user_id ORDER BY t) AS next, lag(step) OVER (PARTITION BY user_id ORDER BY t) AS former FROM ({_EV})"


@query("trajectories_check", f"SELECT count_if(next = step)::BIGINT AS unchanged, count_if(next > step + 1)::BIGINT AS gaps, count_if((former IS NULL OR former > step) AND step <> 1)::BIGINT AS starts FROM ({_ODD})")
def _odd_steps(spark, d):
    found = temporal.check_trajectories(events(spark, d), "t", "step", ["user_id"])
    return spark.createDataFrame([tuple(found.values())], "unchanged long, gaps long, starts long")


@query("moving_average_centered", f"SELECT user_id, event_id, round(CASE WHEN count(*) OVER w = 4 THEN avg(value) OVER w END, 6) AS value FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def _moving(spark, d):
    return r6(temporal.moving_average(events(spark, d), ["user_id"], "t", {"value": 4}).select("user_id", "event_id", "value"))


@query("lag_variables", f"SELECT user_id, t::INTEGER AS t, round(value, 6) AS value_lag0, round(lag(value, 2) OVER w, 6) AS value_lag2, step::INTEGER AS step_lag0 FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t) QUALIFY row_number() OVER w > 2")
def _lags(spark, d):
    return r6(temporal.lag_table(events(spark, d).withColumn("step", F.col("step").cast("int")), ["user_id"], "t", {"value": (2, 2), "step": (1, 1)}))


@query("autocorrelation_by_lag", f"WITH e AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY user_id) AS d FROM ({_EV})), s AS (SELECT user_id, d, " + ", ".join(f"lag(d, {k}) OVER (PARTITION BY user_id ORDER BY t) AS k{k}" for k in (1, 2, 3)) + " FROM e), g AS (SELECT user_id, sum(d * d) AS v, " + ", ".join(f"coalesce(sum(d * k{k}), 0) AS s{k}" for k in (1, 2, 3)) + " FROM s GROUP BY 1) " + " UNION ALL ".join(f"SELECT user_id, {k} AS lag, round(CASE WHEN v > 0 THEN s{k} / v END, 6) AS acf FROM g" for k in (1, 2, 3)))
def _acf(spark, d):
    return r6(temporal.autocorrelation(events(spark, d), ["user_id"], "t", "value", [1, 2, 3]))


@query("estimate_dynamic")
def _dynamic(spark, d):
    return temporal.estimate_dynamic(events(spark, d), ["user_id"], "t", ["value", "step"])


_LENGTHS = "SELECT length, count(*) AS n FROM (SELECT user_id, count(*) AS length FROM events GROUP BY 1) GROUP BY 1"
_SPAN = 60


@query("longest_lag_window", f"WITH l AS ({_LENGTHS}), k AS (SELECT k, sum(greatest(0, length - k) * n) AS left_over FROM l, range(1, {_SPAN}) r(k) GROUP BY 1), t AS (SELECT least(1000, sum(length * n) / 10) AS target FROM l) SELECT (SELECT sum(greatest(0, length - {_SPAN}) * n)::BIGINT FROM l) AS samples_before, coalesce(max(k), 1)::INTEGER AS lag FROM k, t WHERE left_over >= target")
def _window(spark, d):
    lengths = temporal.trajectory_lengths(table(spark, d, "events"), ["user_id"])
    rows = table(spark, d, "events").count()
    return spark.createDataFrame([(temporal.samples_after(lengths, _SPAN), temporal.longest_window(lengths, min(1000, rows / 10), _SPAN))], "samples_before long, lag int")


@query("relaxation_lags", f"WITH e AS ({_EV}), c AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY user_id) AS d FROM e WHERE value IS NOT NULL), v AS (SELECT user_id, sum(d * d) AS v FROM c GROUP BY 1), a AS (SELECT x.user_id, y.t - x.t AS lag, sum(x.d * y.d) AS s FROM c x JOIN c y ON x.user_id = y.user_id AND y.t > x.t AND y.t <= x.t + 32 GROUP BY 1, 2) SELECT user_id, lag::INTEGER AS lag, round(s / v, 6) + 0.0 AS acf FROM a JOIN v USING (user_id) WHERE v > 0")
def _relaxation(spark, d):
    return r6(temporal.autocorrelation_until(events(spark, d), ["user_id"], "t", "value", 32)[0])


@query("temporal_network")
def _temporal(spark, d):
    from causalnet.operators.timeseries import reconstruct_series

    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    from pyspark.sql import Window

    e = e.withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("user_id", "t", "event_type", F.round(F.col("value"), 0).alias("value"))
    return r6(reconstruct_series(e, ["user_id"], "t", ["event_type", "value"], n_layers=3, delta_t=1).edges.select("x", "y", "n", "info", "cplx", "info_shifted", "connected", "ort_inferred"))


@query("lagged_pair_lists", "SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'A_lag0' ELSE l_returnflag || '_lag' || l_linenumber END AS var1, l_linestatus || '_lag0' AS var2 FROM lineitem")
def _lagged_pairs(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("var1"), F.col("l_linestatus").alias("var2"), F.col("l_linenumber").alias("lag"))
    return temporal.lagged_pairs(pairs, ["A"])


@query("stationarity_repeat_edges", "WITH p AS (SELECT *, regexp_replace(x, '_lag[0-9]+$', '') AS xv, regexp_extract(x, '_lag([0-9]+)$', 1)::INTEGER AS xl, regexp_replace(y, '_lag[0-9]+$', '') AS yv, regexp_extract(y, '_lag([0-9]+)$', 1)::INTEGER AS yl FROM " + LAGGED_SQL + ") SELECT xv || '_lag' || (xl + s) AS x, yv || '_lag' || (yl + s) AS y, round(info_shifted, 6) + 0.0 AS info_shifted FROM p, range(0, 3) r(s) WHERE greatest(xl, yl) + s <= 2")
def _repeat(spark, d):
    return r6(temporal.repeat_over_history(lagged(spark, d), 3))


_FLAT = "SELECT CASE WHEN o THEN xv ELSE yv END AS x, CASE WHEN o THEN yv ELSE xv END AS y, abs(xl - yl)::INTEGER AS lag, round(info_shifted, 6) + 0.0 AS info_shifted FROM (SELECT *, xl > yl OR (xl = yl AND xv <= yv) AS o FROM (SELECT *, regexp_replace(x, '_lag[0-9]+$', '') AS xv, regexp_extract(x, '_lag([0-9]+)$', 1)::INTEGER AS xl, regexp_replace(y, '_lag[0-9]+$', '') AS yv, regexp_extract(y, '_lag([0-9]+)$', 1)::INTEGER AS yl FROM " + LAGGED_SQL + "))"
_FLATS = {
    "compact": _FLAT,
    "drop": f"SELECT * FROM ({_FLAT}) WHERE x <> y",
    "combine": f"SELECT least(x, y) AS x, greatest(x, y) AS y, string_agg(DISTINCT lag::VARCHAR, ',' ORDER BY lag::VARCHAR) AS lags, max(info_shifted) AS info_shifted FROM ({_FLAT}) GROUP BY least(x, y), greatest(x, y)",
    "unique": f"SELECT least(x, y) AS x, greatest(x, y) AS y, lag, info_shifted FROM ({_FLAT}) QUALIFY row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY info_shifted DESC, lag) = 1",
}
for _k, _q in _FLATS.items():

    @query(f"flatten_{_k}", _q)
    def _flat(spark, d, k=_k):
        return r6(temporal.flatten(lagged(spark, d), k))


_O = "CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -2 ELSE 6 END"
_TIPPED = (
    f"SELECT l_linestatus || l_returnflag || '_lag' || (l_orderkey % 4) AS x, o_orderstatus || l_returnflag || '_lag0' AS y, {_O} AS o, avg(l_discount) * 10 AS p, avg(l_tax) * 12 AS q, sum(l_quantity) AS info_shifted "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"
)


@query(
    "flatten_combine_tips",
    f"WITH f AS (SELECT regexp_replace(x, '_lag[0-9]+$', '') AS x, regexp_replace(y, '_lag[0-9]+$', '') AS y, regexp_extract(x, '_lag([0-9]+)$', 1)::INTEGER AS lag, o, p, q, info_shifted FROM ({_TIPPED})), "
    "k AS (SELECT *, least(x, y) AS u, greatest(x, y) AS v, x > y AS down FROM f), "
    "w AS (SELECT u, v, CASE WHEN o = -2 THEN y < x ELSE x < y END AS fore, CASE WHEN o = -2 THEN -lag ELSE lag END AS lag FROM k UNION SELECT u, v, y < x, -lag FROM k WHERE o = 6 AND lag <> 0), "
    "l AS (SELECT u, v, string_agg(lag::VARCHAR, ',' ORDER BY lag DESC) FILTER (fore AND lag <> 0) AS a, max('0') FILTER (lag = 0) AS b, string_agg(lag::VARCHAR, ',' ORDER BY lag) FILTER (NOT fore AND lag <> 0) AS c FROM (SELECT DISTINCT * FROM w) GROUP BY 1, 2), "
    "g AS (SELECT u, v, count(*) AS n, any_value(x) AS x, any_value(y) AS y, any_value(lag) AS lag, any_value(o) AS o, any_value(p) AS p, any_value(q) AS q, min(CASE WHEN down AND abs(o) = 2 THEN -o ELSE o END) AS low, max(CASE WHEN down AND abs(o) = 2 THEN -o ELSE o END) AS high, max(info_shifted) AS info_shifted, "
    "min(CASE WHEN down THEN q ELSE p END) AS np, max(CASE WHEN down THEN q ELSE p END) AS xp, avg(CASE WHEN down THEN q ELSE p END) AS ap, min(CASE WHEN down THEN p ELSE q END) AS nq, max(CASE WHEN down THEN p ELSE q END) AS xq, avg(CASE WHEN down THEN p ELSE q END) AS aq FROM k GROUP BY 1, 2), "
    "t AS (SELECT *, CASE WHEN high = 6 OR (low = -2 AND high = 2) THEN 6 WHEN high = 2 THEN 2 WHEN low = -2 THEN -2 ELSE 1 END AS oo FROM g JOIN l USING (u, v)) "
    "SELECT CASE WHEN n = 1 THEN x ELSE u END AS x, CASE WHEN n = 1 THEN y ELSE v END AS y, CASE WHEN n = 1 THEN lag::VARCHAR WHEN a IS NOT NULL AND c IS NOT NULL THEN concat_ws('/', a, b, c) ELSE concat_ws(',', a, b, c) END AS lags, CASE WHEN n = 1 THEN o ELSE oo END AS ort_inferred, "
    "round(CASE WHEN n = 1 THEN p WHEN oo IN (6, -2) THEN xp WHEN oo = 2 THEN np ELSE ap END, 6) + 0.0 AS p_y2x, round(CASE WHEN n = 1 THEN q WHEN oo IN (6, 2) THEN xq WHEN oo = -2 THEN nq ELSE aq END, 6) + 0.0 AS p_x2y, round(info_shifted, 6) + 0.0 AS info_shifted FROM t",
)
def _combine_tips(spark, d):
    name = lambda v, k: F.concat(F.col(v), F.col("l_returnflag"), F.lit("_lag"), k.cast("string"))
    both = lines_and_orders(spark, d).select(name("l_linestatus", F.col("l_orderkey") % 4).alias("x"), name("o_orderstatus", F.lit(0)).alias("y"), F.expr(_O).alias("ort_inferred"), "l_discount", "l_tax", "l_quantity")
    e = both.groupBy("x", "y", "ort_inferred").agg((F.avg("l_discount") * 10).alias("p_y2x"), (F.avg("l_tax") * 12).alias("p_x2y"), F.sum("l_quantity").alias("info_shifted"))
    return r6(temporal.combined(e))


# Exports

_SUM = "SELECT l_returnflag AS x, l_linestatus AS y, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN -2 WHEN 4 THEN 6 ELSE 0 END AS ort_inferred, l_quantity AS info_shifted, l_discount AS partial_correlation FROM lineitem"


def summary_table(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.expr("CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN -2 WHEN 4 THEN 6 ELSE 0 END").alias("ort_inferred"), F.col("l_quantity").alias("info_shifted"), F.col("l_discount").alias("partial_correlation"))


@query("export_edges", f"SELECT CASE WHEN o = -2 THEN y ELSE x END AS source, CASE WHEN o = -2 THEN x ELSE y END AS target, CASE WHEN abs(o) = 2 THEN 'directed' WHEN o = 6 THEN 'bidirected' ELSE 'undirected' END AS kind, CASE WHEN abs(o) = 2 OR o = 6 THEN 6 ELSE 0 END AS target_arrow, CASE WHEN o = 6 THEN 6 ELSE 0 END AS source_arrow, round(greatest(log10(info_shifted), 0.2), 6) AS width, round(CASE WHEN info_shifted <= 1 THEN 1.0 WHEN info_shifted >= 20 THEN 8.0 ELSE info_shifted * 8 / 20 END, 6) AS weight, round((partial_correlation + 1) * 100)::INTEGER AS colour_step, CASE WHEN o = -2 THEN y ELSE x END || CASE WHEN abs(o) = 2 THEN '-->' WHEN o = 6 THEN '<->' ELSE '---' END || CASE WHEN o = -2 THEN x ELSE y END AS label FROM (SELECT *, ort_inferred AS o FROM ({_SUM})) WHERE o <> 0")
def _export(spark, d):
    return r6(sinks.export_edges(summary_table(spark, d)))


@query("export_nodes", f"SELECT name, count(*) AS degree FROM (SELECT x AS name FROM ({_SUM}) WHERE ort_inferred <> 0 UNION ALL SELECT y FROM ({_SUM}) WHERE ort_inferred <> 0) GROUP BY 1")
def _nodes(spark, d):
    return sinks.export_nodes(summary_table(spark, d))


@query("graphml_lines")
def _graphml(spark, d):
    s = summary_table(spark, d).groupBy("x", "y").agg(F.min(F.struct("ort_inferred", "info_shifted", "partial_correlation")).alias("least")).select("x", "y", "least.*")
    return spark.createDataFrame([(i, x) for i, x in enumerate(sinks.graphml_lines(s, ["A", "F", "N", "O", "R"]))], "i int, line string")

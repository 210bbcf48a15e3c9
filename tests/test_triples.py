"""Triples of graphs with hubs, triangles, loops, double edges and unknown ends, beside plain loops."""

import random

import pytest

from causalnet.operators import graph


def plain(rows):
    near = {(a, b) for x, y in rows if x is not None and y is not None for a, b in ((x, y), (y, x))}
    nodes = sorted({a for a, _ in near})
    triples = sorted((a, z, b) for z in nodes for a in nodes for b in nodes if a < b and (a, z) in near and (b, z) in near and (a, b) not in near)
    used = {tuple(sorted(p)) for a, z, b in triples for p in ((a, z), (b, z))}
    return triples, sorted((r for r in rows if None in r or tuple(sorted(r)) not in used), key=repr)


def odd_graph(seed):
    r = random.Random(seed)
    rows = [(f"n{r.randrange(24)}", f"n{r.randrange(24)}") for _ in range(60)] + [("hub", f"n{i}") for i in range(24)]
    clique = [(f"c{i}", f"c{j}") for i in range(6) for j in range(i)] + [("c0", "c1"), ("c2", "c2")]
    return rows + clique + [("n1", "n1"), ("alone", "alone"), ("pair", "other"), (None, "n1"), ("n2", None), (None, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_triples_in_blocks(spark, seed):
    rows = odd_graph(seed)
    edges = spark.createDataFrame(rows, "x string, y string")
    triples, outside = plain(rows)
    assert sorted(tuple(r) for r in graph.unshielded_triples(edges, block=4).collect()) == triples
    assert sorted((tuple(r) for r in graph.edges_outside_triples(edges).collect()), key=repr) == outside
    given = spark.createDataFrame(triples, "x string, z string, y string")
    assert sorted((tuple(r) for r in graph.edges_outside_triples(edges, given).collect()), key=repr) == outside


def test_edges_outside_form_no_triples(spark):
    """A star of 40,000 has 800 million triples; its edges are judged without them."""
    star = spark.range(40_000).selectExpr("'hub' AS x", "concat('n', id) AS y").unionByName(spark.createDataFrame([("p", "q")], "x string, y string"))
    assert [tuple(r) for r in graph.edges_outside_triples(star).collect()] == [("p", "q")]


def test_triples_of_a_hub_are_dealt(spark):
    """Not one group holds the pairs of a node of many neighbours."""
    from pyspark.sql import functions as F

    star = spark.range(2_000).selectExpr("'hub' AS x", "concat('n', id) AS y")
    found = graph.unshielded_triples(star, block=100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in found) == 2_000 * 1_999 // 2 and max(r["count"] for r in found) < 1_500_000 and len(found) > 1

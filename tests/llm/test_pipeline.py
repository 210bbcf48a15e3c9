"""The pipeline on awkward tables, and as a whole."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from causalnet.llm import shared

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, component int, row int, keys string, part int, size double"


def test_every_stage_on_awkward_rows(spark):
    r = random.Random(8)
    text = lambda n: ". ".join(" ".join(r.choice(["the", "of", "house", "tree", "river", "a", "stone"]) + str(r.randint(0, 50)) for _ in range(9)) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n"), (None, text(20)), (4, text(20)), (4, text(20)), (5, "x" * 40_000), (6, text(3000)), (7, "mail a@b.co " + text(9))]
    same = text(30)
    rows += [(8, same), (8, same), (9, same), (None, same), (10, same + " end")]
    full = [(i, t, None if i == 4 else "en", None if i == 5 else "s", None, 1, "t", 2, 3, "k", 4, 0.5) for i, t in rows]
    d = spark.createDataFrame(full, SCHEMA)
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = shared.durable(stage(spark, d, SF), name)
        assert d.columns == columns, name
        if name == "near_dedup":
            left = collections.Counter(x["doc_id"] for x in d.collect())
            assert left[8] <= 1 and left[9] == left[10] == 0 and max(left.values()) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    sums = last.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") ** 2).alias("c"))
    assert sums.where(f"t > {corpus_pipeline.SEQUENCE} or n > {corpus_pipeline.DOCUMENTS} or c > {corpus_pipeline.COST}").count() == 0 and last.count() > 0


def test_every_stage_on_an_empty_table(spark):
    d = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert shared.durable(stage(spark, d, SF), name).count() == 0


def test_run_leaves_only_its_result(spark):
    before = list(shared.made)
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and len(set(shared.made) - set(before)) == 1


@pytest.mark.parametrize("small", [20_000, 5])
def test_components_against_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(shared, "SMALL_GRAPH", small)
    monkeypatch.setattr(shared, "FEW", 20)
    r = random.Random(small)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 120)] + [(-i, -i - 1) for i in range(1, 60)] + [(7, None), (None, 8), (9, 9)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    got = {x["node"]: x["component"] for x in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def test_lookup_keeps_every_row_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 10)
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = spark.createDataFrame([(1, "hot"), (2500, "cold")], "k long, name string")
    inner = shared.lookup(rows, table, ["k"]).groupBy("name").count().collect()
    assert {x["name"]: x["count"] for x in inner} == {"hot": 2000, "cold": 1}
    assert shared.lookup(rows, table, ["k"], "left").count() == 3000


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())

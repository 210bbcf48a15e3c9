from causalnet.queries import QUERIES


def test_exports_read_every_order(spark, tmp_path):
    rows = [(k, n, "A" if k < 2000 else "R", "F", 5.0, 0.05) for k in (1, 1999, 2000, 700_000) for n in (1, 3, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = QUERIES["export_edges"](spark, str(tmp_path)).collect()
    assert sorted(r["source"] + r["target"] for r in edges) == sorted(["AF", "FA", "RF", "FR"] * 2)
    assert {r["name"]: r["degree"] for r in QUERIES["export_nodes"](spark, str(tmp_path)).collect()} == {"A": 4, "R": 4, "F": 8}
    assert any('source="R"' in r["line"] or 'target="R"' in r["line"] for r in QUERIES["graphml_lines"](spark, str(tmp_path)).collect())

from pyspark.sql import functions as F

from causalnet.llm import pii


def test_secret_is_proposed_without_any_digit(spark):
    d = spark.createDataFrame([(1, "password: AbcdefGhijkLmnopQrst ok"), (2, "password: AbcdefGhijkLmnopQrst 7"), (3, "plain words")], "i int, t string")
    got = {r["i"]: [c["s"] for c in r["c"]] for r in d.select("i", pii.candidates(F.col("t")).alias("c")).collect()}
    assert got == {1: ["AbcdefGhijkLmnopQrst"], 2: ["AbcdefGhijkLmnopQrst"], 3: []}

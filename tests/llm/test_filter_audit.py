"""The trie of filters against a plain run of every order."""

import collections
import itertools

import oracle
import pytest
from conftest import SF
from pyspark.sql import functions as F

from causalnet.llm import filter_audit, queries
from causalnet.llm.oracles import ORACLES
from causalnet.llm.shared import durable

SCHEMA = "doc_id long, text string, lang string, part string, id long, A boolean, k1 long, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(rows):
    """(part, set of failed filters, id) of each row, by the definitions."""
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        caps = sum("A" <= c <= "Z" for c in t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        bad["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((lang or "", {k for k, v in bad.items() if v}, i))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged, out, total = fails(rows), {}, collections.Counter()
    for part in {p for p, _, _ in judged}:
        mine = [(f, i) for p, f, i in judged if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                total[part, k] += len(gone)
                earlier = sum(k in f for f, _ in mine) - len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), earlier, sum(f == {k} for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), k)
    return {key: (*v[:-1], total[key[0], v[-1]]) for key, v in out.items()}


def test_all_orders(spark):
    words = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, None, "en"), (2, "", None), (3, words, "en"), (4, words, "en"), (4, words, "de"), (5, words + " #", "en"), (None, words, "en"), (None, "", ""), (6, "A" * 500, "de"), (7, "a " * 300, "de"),
        (8, ("a " * 300) + "| ABCDEFGHIJKLMNOPQRSTUVWXYZ", "en"), (9, "é" * 40 + "A", "fr"), (10, words.replace("w", "é"), "fr"), (11, words.upper(), "fr"), (12, "x\xa0y", "fr"), (13, words + "\x0b\x1cz", "de"), (0, "\n", "en"), (14, words * 40, "en"),
    ]
    labels = [(3, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (6, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "p", 7, True, 1, "q") for r in rows], SCHEMA).repartition(3)
    verdicts = filter_audit.verdicts(docs, spark.createDataFrame([(*x, "t") for x in labels], LABELS))
    found = filter_audit.audit(verdicts, filter_audit.FIVE).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found}
    assert len(found) == len(got) == 600 * 4
    assert got == plain(rows, labels)


def test_states_are_shared(spark):
    df = durable(spark.range(40).select(F.lit("p").alias("part"), (F.col("id") % 3 == 0).alias("good"), F.lit(False).alias("toxic"), "id"), "rows")
    calls = []

    def by(k):
        def f(survivors):
            calls.append(k)
            return F.col("id") % k == 0

        return f

    states, edges = filter_audit.explore(df, {str(k): by(k) for k in (2, 3, 5)})
    assert len(calls) == 3 * 2 ** 2  # an edge each, not an order each
    n = {r["state"]: r["n"] for r in states.collect()}
    assert n == {s: sum(all(i % k for b, k in enumerate((2, 3, 5)) if s >> b & 1) for i in range(40)) for s in range(8)}
    for r in edges.collect():
        assert n[r["state"]] - r["removed"] == n[r["state"] | 1 << r["k"]]
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        filter_audit.explore(df, {str(k): by(k) for k in range(2, 10)})


def test_null_verdicts_fail_nothing_and_empty_tables(spark):
    df = durable(spark.createDataFrame([("p", None, True, False), ("p", True, False, True)], "part string, X boolean, good boolean, toxic boolean"), "rows")
    r = filter_audit.audit(df, {"X": lambda d: F.col("X")}).collect()
    assert [(x["kept"], x["removed"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in r] == [(1, 1, 0, 1, 1)]
    none = filter_audit.verdicts(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(none, filter_audit.FIVE).count() == 0


def test_query_equals_sql(spark):
    assert oracle.differ(queries.op11_filter_audit(spark, SF), oracle.connect(SF), ORACLES["op11_filter_audit"]) == ""

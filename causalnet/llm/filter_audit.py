"""What filters remove depending on their order: all orders executed as a trie of persisted survivors.

The orders of n filters are the paths of a trie. It is walked depth first: at a node the survivors of the filters so
far are persisted, one job counts what every filter yet to come removes from them, and each child is the
same rows with one more filter applied. Two prefixes that hold the same filters have the same survivors, so a
node is visited once for its set of filters (2^n states and n 2^(n-1) edges in place of n! paths), and its rows
are let go once all below it is counted: at most n + 1 nested states are persisted at once. They come
from a durable table of a few bytes a document, so a lost executor's part is made again from there.

``verdicts`` gives that table for the five filters of the contract; ``audit`` takes any filters whose verdict on a row
doesn't hang on which other rows are left.

Defined cases: a null text is empty; a null part is the empty string; whole texts are read, however long; a null
document id is never a copy of another nor the first of copies, and no label is its own; repeated rows count
each, and a row whose text only rows of its own id share is no copy; of several labels of one document any 1 counts;
extra columns of any name are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import delete, durable, lookup, made, ship

#: Orders grow with the factorial of the filters.
MOST_FILTERS = 7
_UPPER = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*|"
_FURTHER = bytes(range(0x80, 0xC0))  # all but the first byte of a character


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, c, d = [], [], [], []
        for t in batch.column("text"):
            t = t.as_buffer().to_pybytes()
            words = t.split()
            a.append(len(words) < 200)
            b.append(100 * len(set(words)) < 50 * len(words))
            chars = len(t) if t.isascii() else len(t.translate(None, _FURTHER))
            c.append(100 * (len(t) - len(t.translate(None, _UPPER))) > 3 * chars)
            d.append(len(t.translate(None, _SYMBOLS)) < len(t))
        flags = [pa.array(v, pa.bool_()) for v in (a, b, c, d)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "part", "k1", "k2")), *flags], ["id", "part", "k1", "k2", "A", "B", "C", "D"])


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, A, B, C, D, E, good, toxic), a durable table with a row per document: true where it fails.

    A: under 200 words; B: under half of them distinct; C: over 3 % capitals; D: holds one of ``#$%&*|``; E: the same
    text has a smaller id. Copies meet by two 64-bit hashes of the text, and a text that a share of the
    table has is counted before it is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))
    seen = durable(rows.mapInArrow(_measured, "id long, part string, k1 long, k2 long, A boolean, B boolean, C boolean, D boolean"), "measured")
    groups = durable(seen.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "copies")
    out = lookup(seen, groups.select("k1", "k2", "first"), ["k1", "k2"], "left", groups.select("k1", "k2", "n"))
    out = out.select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("E"))
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    named = out.where("id is not null").join(known, "id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    return durable(named.unionByName(out.where("id is null").withColumns({"good": no, "toxic": no})), "verdicts")


def explore(rows: DataFrame, filters: Mapping[str, Callable[[DataFrame], Column]], part: str = "part", good: str = "good", toxic: str = "toxic") -> tuple[DataFrame, DataFrame]:
    """(states, edges) of the trie, from ``rows`` (a durable table).

    states: (part, state, n), the survivors of each set of filters (bit k of ``state``: the k-th filter); edges: (part, state,
    k, removed, unique, good, toxic), what filter k removes from them, how many of these fail no other of
    the filters yet to come, and how many carry each label. Parts without survivors have no row."""
    names, spark = list(filters), rows.sparkSession
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited")
    known: dict[int, str] = {}  # state -> its counts

    def visit(state: int, survivors: DataFrame) -> None:
        left = [k for k in range(len(names)) if not state >> k & 1]
        fails = {k: F.coalesce(filters[names[k]](survivors), F.lit(False)) for k in left}
        survivors = survivors.persist()
        try:
            total = sum((f.cast("int") for f in fails.values()), F.lit(0))
            removed = [
                F.struct(F.lit(k).alias("k"), F.count_if(f).alias("removed"), F.count_if(f & (total == 1)).alias("unique"), F.count_if(f & F.col(good)).alias("good"), F.count_if(f & F.col(toxic)).alias("toxic"))
                for k, f in fails.items()
            ]
            edges = F.array(*removed) if removed else F.expr("cast(array() as array<struct<k:int,removed:bigint,unique:bigint,good:bigint,toxic:bigint>>)")
            counts = survivors.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), edges.alias("edges")).withColumn("state", F.lit(state))
            durable(counts, "state")
            known[state] = made[-1]
            for k in left:
                if state | 1 << k not in known:
                    visit(state | 1 << k, survivors.where(~fails[k]))
        finally:
            survivors.unpersist()

    visit(0, rows)
    schema = "part string, n bigint, edges array<struct<k:int,removed:bigint,unique:bigint,good:bigint,toxic:bigint>>, state int"
    whole = durable(spark.read.schema(schema).parquet(*known.values()), "states")
    delete(spark, list(known.values()))
    return whole.select("part", "state", "n"), whole.select("part", "state", F.explode("edges").alias("e")).select("part", "state", "e.*")


def audit(rows: DataFrame, filters: Mapping[str, Callable[[DataFrame], Column]], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each
    part, order and step. ``kept`` are the counted survivors of the state after the step, ``removed`` the edge's
    count; shapley is the sum of a filter's removals over all orders."""
    states, edges = explore(rows, filters, part, good, toxic)
    names, steps = list(filters), []
    for order in permutations(range(len(names))):
        state = 0
        for i, k in enumerate(order):
            steps.append(("".join(names[j] for j in order), i + 1, k, state, state | 1 << k))
            state |= 1 << k
    steps = F.broadcast(rows.sparkSession.createDataFrame(steps, "filter_order string, step int, k int, state int, after int"))  # n! n rows, n at most MOST_FILTERS
    alone = edges.where("state = 0").select("part", "k", F.col("removed").alias("fails"), F.col("unique").alias("unique_fails"))
    out = alone.join(steps, "k").join(edges.drop("unique"), ["part", "state", "k"], "left").join(states.select("part", F.col("state").alias("after"), F.col("n").alias("kept")), ["part", "after"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = durable(out.select("part", "filter_order", "step", "k", zero("kept").alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"), "unique_fails", zero("good").alias("good_lost"), zero("toxic").alias("toxic_lost")), "audit")
    shapley = out.groupBy("part", "k").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "k"]).drop("k")


#: The verdict columns of ``verdicts`` as filters.
FIVE = {name: (lambda df, name=name: F.col(name)) for name in "ABCDE"}

"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, shuffled by a seeded hash, form a flow; a document's virtual finish time is
the flow's cumulative tokens up to it divided by the source's target. The flows' documents (in as
many epochs as the cap allows) are range-sorted by finish time and taken until the total budget is used.

All three orders (sources, flows, finish times) are range-sorted tables with running sums by two
levels (``shared.running``), so no task holds a source, and a range holds a bounded number of rows.
Only totals and the last document taken reach the driver.

Defined cases: null texts have size 0 and are never taken more than in name (taken 0); so have texts
without a word; whole texts are counted, however long; null sources are one source, last in order;
null ids keep their rows; repeated rows count and are taken each by itself; ties of finish time go by
the seeded hash, then by source; extra columns of any name stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import WORD, durable, lookup, release, row_hash, running

#: What orders the copies of documents: finish time, then what settles ties.
QUEUE = ("f", "turn", "s", "e", "rh")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: float, cap: float) -> DataFrame:
    """(source, s, source_size, target, before) of sizes (source, size): s counts sources by name, null
    last; before is the size of all sources before it.

    A share of ``total`` by weight, none above ``cap`` times its size, the excess reshared by weight: with
    the sources in order of cap * size / weight, the first that its share of what the former leave does
    not fill sets the level of it and all after it."""
    last = F.col("source").isNull().alias("last")
    named = running(sizes.select("source", "size", last, F.coalesce("source", F.lit("")).alias("name")), ["last", "name"], {"n": "1", "upto": "size"}, "sources")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ratio = F.lit(float(cap)) * F.col("size") / F.col("w")
    named = durable(named.withColumn("w", w).withColumn("ratio", ratio), "sources")
    scale = max(1, *(len(str(float(x)).partition(".")[2]) for x in weights))
    filled = running(named.withColumn("units", F.round(F.col("w") * 10**scale).cast("long")), ["ratio", "n"], {"sum_size": "size", "sum_units": "units"}, "sources")
    units = named.agg(F.sum(F.round(F.col("w") * 10**scale).cast("long"))).collect()[0][0] or 0
    left = F.lit(float(total)) - F.lit(float(cap)) * (F.col("sum_size") - F.col("size"))
    level = left / ((F.lit(units) - (F.col("sum_units") - F.col("units"))) / F.lit(float(10**scale)))
    first = filled.withColumn("level", level).where(F.col("level") < F.col("ratio")).agg(F.min(F.struct("ratio", "n", "level")).alias("k")).collect()[0]["k"]
    target = F.lit(float(cap)) * F.col("size") if first is None else F.when((F.col("ratio") < first["ratio"]) | ((F.col("ratio") == first["ratio"]) & (F.col("n") < first["n"])), F.lit(float(cap)) * F.col("size")).otherwise(F.lit(first["level"]) * F.col("w"))
    return named.select("source", (F.col("n") - 1).cast("int").alias("s"), F.col("size").alias("source_size"), target.alias("target"), (F.col("upto") - F.col("size")).alias("before"))


def flows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], budget: float, cap: int, seed: int) -> tuple[DataFrame, Column]:
    """(table, takes): a durable row for each document with the end of its flow up to it and its ``row_hash``
    rh, and the array of (finish, epoch) at which the mix takes it."""
    text, ident = F.col(text_col).cast("string"), F.col(id_col)
    sized = durable(
        docs.select(
            ident.alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))).alias("turn"), row_hash(docs).alias("rh"),
            F.col(source_col).isNull().alias("z"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("k"),
        ),
        "sizes",
    )
    sums = durable(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    total = budget * (sums.agg(F.sum("size")).collect()[0][0] or 0)
    targets = durable(source_targets(sums.select("source", "size"), weights, total, cap), "targets")
    key = lambda d: d.withColumn("z", F.col("source").isNull()).withColumn("k", F.coalesce("source", F.lit("")))
    counts = key(sums).select("z", "k", "n")
    dealt = lookup(sized, key(targets).drop("source"), ["z", "k"], counts=counts).drop("z", "k")
    placed = running(dealt, ["s", "turn", "rh"], {"all": "size"}, "flows").withColumn("upto", F.col("all") - F.col("before")).drop("all", "before")
    placed = durable(placed, "flows")

    def finish(e: int) -> Column:
        return F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("upto") + e * F.col("source_size")) / F.col("target"))

    times = F.array(*(F.struct(finish(e).alias("f"), F.lit(e).alias("e")) for e in range(cap)))
    copies = placed.select("size", "turn", "s", "rh", F.explode(F.filter(times, lambda x: x["f"].isNotNull())).alias("x")).select("x.f", "turn", "s", "x.e", "rh", "size")
    queue = running(copies, QUEUE, {"used": "size"}, "queue")
    last = queue.where(F.col("used") <= F.lit(total)).agg(F.max(F.struct(*QUEUE)).alias("k")).collect()[0]["k"]
    if last is None:
        return placed, F.filter(times, lambda x: F.lit(False))
    end = F.struct(*(F.lit(last[c]).alias(c) for c in QUEUE))
    return placed, F.filter(times, lambda x: x["f"].isNotNull() & (F.struct(x["f"].alias("f"), "turn", "s", x["e"].alias("e"), "rh") <= end))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2, seed: int = 42) -> DataFrame:
    """(id, source, size, source_size, target, finish, epochs) of every row: epochs is how often it is
    taken, finish its first virtual finish time (null where it has none)."""
    placed, takes = flows(docs, id_col, text_col, source_col, weights, budget, cap, seed)
    finish = F.when((F.col("target") > 0) & (F.col("size") > 0), F.col("upto") / F.col("target"))
    return placed.select("id", "source", "size", "source_size", "target", finish.alias("finish"), F.size(takes).alias("epochs"))


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2, seed: int = 42) -> DataFrame:
    """(finish, epoch, row): a row for each time that the mix takes a document, range-sorted by finish time."""
    placed, takes = flows(docs, id_col, text_col, source_col, weights, budget, cap, seed)
    i, no, rh = keys = ["id_", "no_", "rh_"]
    name = lambda c: (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(i), F.col(c).isNull().alias(no))
    taken = placed.withColumn("x", F.explode(takes)).select(*name("id"), F.col("rh").alias(rh), F.col("x.f").alias("finish"), F.col("x.e").alias("epoch"), "turn", "s")
    release(docs.sparkSession)
    # Rows equal in all columns are one row of this table, and meet the takes of all of them.
    own = docs.select(*name(id_col), row_hash(docs).alias(rh), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).dropDuplicates(keys)
    out = lookup(durable(taken, "takes"), own, keys)
    order = ("finish", "turn", "s", "epoch", rh)
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("finish", "epoch", "row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents as the mix takes them, in the order of the queue: a row for each time that it takes one."""
    return queued(docs, id_col, text_col, **options).select("row.*")

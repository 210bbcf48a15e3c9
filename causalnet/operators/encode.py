"""Codes of levels and equal-frequency bins that never split equal values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders.
RANGE = 1 << 20


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code, n): the known levels in order, codes from 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return running(counts.withColumn("one_", F.lit(1)), "level", {"code": "one_"}).select("level", "n", (F.col("code") - 1).cast("int").alias("code"))


def encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each column replaced by its code; unknown stays null. The map has a row per level."""
    out = df
    for c in columns:
        table = level_codes(df, c).select(F.col("level").alias("level_"), F.col("code").alias("code_"))
        out = out.join(table, F.col(c) == F.col("level_"), "left").withColumn(c, F.col("code_")).drop("level_", "code_")
    return out.select(*df.columns)


def running(df: DataFrame, order: str, amounts: dict[str, str], how: str = "sum", span: int | None = None, rows: int | None = None) -> DataFrame:
    """Adds running aggregates over the whole table in the order of ``order``, by two levels: within ranges of about ``span``
    rows, then over the ranges, so no task sees all rows of a large table. A small one is a single range. ``rows``, about how many
    there are, saves a count."""
    f, span = getattr(F, how), span or RANGE
    parts = -(-(df.count() if rows is None else rows) // span)
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, 0)
    if parts <= 1:
        return df.withColumns({n: f(c).over(before(Window.orderBy(order))) for n, c in amounts.items()})
    dealt = df.repartitionByRange(parts, order).withColumn("part_", F.spark_partition_id()).persist()  # so that ranges stay as they are
    inside = before(Window.partitionBy("part_").orderBy(order))
    former = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("part_").agg(*(f(c).alias(f"{n}_part") for n, c in amounts.items()))
    ranges = ranges.select("part_", *(f(f"{n}_part").over(former).alias(f"{n}_before") for n in amounts))
    out = dealt.withColumns({n: f(c).over(inside) for n, c in amounts.items()}).join(F.broadcast(ranges), "part_")  # a row a range
    join = (lambda a, b: a + F.coalesce(b, F.lit(0))) if how == "sum" else (lambda a, b: F.least(a, b))
    return out.withColumns({n: join(F.col(n), F.col(f"{n}_before")) for n in amounts}).drop("part_", *(f"{n}_before" for n in amounts))


def equal_frequency(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(value, n, bin): at most ``bins`` bins of about equal counts; equal values share a bin.

    A cut falls every n/bins rows, put off to the end of a run of equal values; after a long run each
    following value opens a bin until the cuts are caught up with. With raw the number of cuts before
    a value and j its place among the values, the bin is j plus the running minimum of raw - j. Works on
    one row per distinct value of a numeric column."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("one_", F.lit(1))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_"))
    placed = running(values, "value", {"upto_": "n", "j_": "one_"}).join(F.broadcast(total))
    raw = F.least(F.floor((F.col("upto_") - F.col("n")) / F.greatest(F.floor(F.col("total_") / bins), F.lit(1))), F.lit(bins - 1))
    low = running(placed.withColumn("low_in_", raw - F.col("j_")), "value", {"low_": "low_in_"}, "min")
    return low.select("value", "n", (F.col("j_") + F.col("low_")).cast("int").alias("bin"))


def with_bins(df: DataFrame, column: str, bins: int, name: str, source: DataFrame | None = None) -> DataFrame:
    """Adds the bin of ``column`` as counted in ``source`` (``df`` itself by default)."""
    table = equal_frequency(source if source is not None else df, column, bins).select(F.col("value").alias("value_"), F.col("bin").alias(name))
    return df.join(table, F.col(column) == F.col("value_"), "left").drop("value_")

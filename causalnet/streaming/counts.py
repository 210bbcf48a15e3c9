"""Contingency counts of a stream: they merge by addition, so information can follow a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_cells(stream: DataFrame, pairs: Sequence[tuple[str, str]], time: str | None = None, window: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(k, v0, v1, n) of a streaming table, as a running total or by event-time window.

    A windowed count closes when the watermark passes, so its state is bounded by levels and windows."""
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(x).cast("string").alias("v0"), F.col(y).cast("string").alias("v1")) for k, (x, y) in enumerate(pairs)))
    keys = [F.window(time, window).alias("w")] if time and window else []
    src = stream.withWatermark(time, lateness) if keys else stream
    own = src.select(*([time] if keys else []), F.explode(rows).alias("r")).select(*([time] if keys else []), "r.*")
    return own.where("v0 is not null and v1 is not null").groupBy(*keys, "k", "v0", "v1").agg(F.count(F.lit(1)).cast("double").alias("n"))

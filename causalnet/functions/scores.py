"""Scalar functions of the orientation and export rules, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(s: Column) -> Column:
    return 1 / (1 + F.exp(-s))


def v_structure_score(i3: Column) -> Column:
    """Log odds of a head at the middle of a triple with negative three-point information."""
    return F.when(i3 < 0, -i3 - math.log(2) + F.log1p(F.exp(i3)))


def induced_score(i3: Column, w: Column) -> Column:
    """Log odds of a tip that follows from a settled head of log odds ``w``."""
    low, high = F.least(F.abs(i3), w), F.greatest(F.abs(i3), w)
    return low - F.log1p(F.exp(low - high) + F.exp(-high))


def dpi_score(i3_shifted: Column, xz: Column, yz: Column) -> Column:
    """Least of the three-point information and the data-processing margin."""
    return F.least(i3_shifted, F.least(xz, yz) - F.log1p(F.exp(-F.abs(xz - yz))))


def accepted_head(p: Column, ratio: Column | float) -> Column:
    return F.when(p > 0, (1 - p) / p < ratio).otherwise(False)


def adjacency_code(tip_x: Column, tip_y: Column) -> Column:
    """0 none, 1 undirected, 2 x to y, -2 y to x, 6 both; a tip is 0 none, 1 tail, 2 head."""
    return F.when((tip_x == 0) | (tip_y == 0), 0).when((tip_x == 2) & (tip_y == 2), 6).when(tip_y == 2, 2).when(tip_x == 2, -2).otherwise(1)


def edge_width(info_shifted: Column) -> Column:
    return F.greatest(F.log10(F.greatest(info_shifted, F.lit(1e-300))), F.lit(0.2))


def edge_weight(info_shifted: Column) -> Column:
    return F.when(info_shifted <= 1, 1.0).when(info_shifted >= 20, 8.0).otherwise(info_shifted * 8 / 20)


def colour_step(correlation: Column) -> Column:
    """Step 0 .. 200 of a palette from -1 to 1."""
    return F.round((correlation + 1) * 100).cast("int")


def pair_key(x: Column, y: Column) -> Column:
    return F.concat_ws("-", F.least(x, y), F.greatest(x, y))

"""Stochastic complexity terms as Spark columns, and the same for numpy kernels."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 1000  # up to here log C(n, 2) is summed, beyond it the closed form holds


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def _binary_exact(n: int, term: np.ndarray) -> float:
    """``term``: h ln h - ln h! of h = 0, 1, ..."""
    return float(np.log(np.exp(term[: n + 1] + term[n::-1] - term[n]).sum()))


@lru_cache(maxsize=None)
def binary_table() -> tuple[float, ...]:
    """log C(n, 2) for n = 1 .. EXACT."""
    term = np.array([(h * math.log(h) if h else 0.0) - math.lgamma(h + 1) for h in range(EXACT + 1)])
    return tuple(_binary_exact(n, term) for n in range(1, EXACT + 1))


def log_c2(n: int) -> float:
    if n <= 0:
        return 0.0
    if n <= EXACT:
        return binary_table()[n - 1]
    return 0.5 * math.log(n * math.pi / 2) + math.sqrt(8 / (9 * n * math.pi)) + (3 * math.pi - 16) / (36 * n * math.pi)


@lru_cache(maxsize=1 << 18)
def log_c(n: int, r: int) -> float:
    """Log of the multinomial normalised-maximum-likelihood regret of n samples over r levels."""
    if n <= 0 or r <= 1:
        return 0.0
    total = log_c2(n)
    ratio = math.exp(total)
    for level in range(3, r + 1):
        ratio = 1 + n / ((level - 2) * ratio)
        total += math.log(ratio)
    return total


def log_c_array(n: np.ndarray, r: int) -> np.ndarray:
    """``log_c`` of whole numbers, each distinct one computed once."""
    values, at = np.unique(np.asarray(n, np.int64), return_inverse=True)
    return np.array([log_c(int(v), r) for v in values])[at].reshape(np.shape(n))


def log_c2_col(n: Column) -> Column:
    x = n.cast("double")
    closed = 0.5 * F.log(x * (math.pi / 2)) + F.sqrt(F.lit(8 / (9 * math.pi)) / x) + F.lit((3 * math.pi - 16) / (36 * math.pi)) / x
    table = F.split(F.lit(",".join(map(repr, binary_table()))), ",").cast("array<double>")  # folded to one literal
    return F.when(n <= 0, 0.0).when(n <= EXACT, F.element_at(table, n.cast("int"))).otherwise(closed)


def log_c_col(n: Column, r: Column) -> Column:
    """``log_c`` of two columns, inside the JVM."""
    start = F.struct(F.exp(log_c2_col(n)).alias("q"), log_c2_col(n).alias("s"))

    def step(a: Column, level: Column) -> Column:
        q = 1 + n.cast("double") / ((level - 2) * a["q"])
        return F.struct(q.alias("q"), (a["s"] + F.log(q)).alias("s"))

    return F.when((n <= 0) | (r <= 1), 0.0).when(r == 2, log_c2_col(n)).otherwise(F.aggregate(F.sequence(F.lit(3), F.greatest(r, F.lit(3)).cast("int")), start, step, lambda a: a["s"]))


def n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log(n)).otherwise(0.0)


def nln(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.where(n > 0, n, 1.0))

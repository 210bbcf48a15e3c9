"""Observation tables: reading, profiling, checking; variable metadata and pair lists."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTINUOUS_FROM = 5  # distinct values from which a numeric variable is continuous


@dataclass(frozen=True)
class Variable:
    name: str
    continuous: bool = False
    contextual: bool = False
    consequence: bool = False
    levels: tuple[str, ...] | None = None
    group: str | None = None
    group_color: str | None = None
    n_layers: int | None = None
    delta_t: int | None = None
    mov_avg: int | None = None
    known: tuple[str, ...] = field(default=(), compare=False)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Observations from any Spark source; NaN becomes NULL."""
    return nan_to_null(spark.read.format(kind).options(**options).load(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(variable, n_known, n_distinct, is_numeric, is_continuous) of each column, in one aggregation."""
    columns = list(columns or df.columns)
    numbers = set(numeric_columns(df))
    one = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(columns)), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n_known"), F.col(f"d{i}").alias("n_distinct"), F.lit(c in numbers).alias("is_numeric")) for i, c in enumerate(columns)))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("is_continuous", F.col("is_numeric") & (F.col("n_distinct") >= CONTINUOUS_FROM))


def check_observations(df: DataFrame, drop_rows: bool = True) -> DataFrame:
    """Drop columns, then rows, without any known value; warn about constants."""
    if df is None or not df.columns:
        raise ValueError("the input has no columns")
    p = {r["variable"]: r for r in profile(df).collect()}
    empty = [c for c in df.columns if p[c]["n_known"] == 0]
    if len(empty) == len(df.columns):
        raise ValueError("the input has no known values")
    if empty:
        warnings.warn(f"columns without known values are dropped: {first_names(empty)}", stacklevel=2)
    if constant := [c for c in df.columns if p[c]["n_distinct"] == 1]:
        warnings.warn(f"constant columns: {first_names(constant)}", stacklevel=2)
    kept = df.drop(*empty)
    return kept.dropna(how="all") if drop_rows else kept


def usable_weights(df: DataFrame, column: str | None) -> bool:
    """Whether ``column`` can weigh rows: numbers from 0 to 1, all known. If it can't, a warning says so."""
    if column is None:
        return False
    if column not in df.columns:
        raise ValueError(f"{column} is not a column, so it can't hold sample weights")
    fair = column in numeric_columns(df) and not df.where(F.col(column).isNull() | ~F.col(column).between(0, 1)).limit(1).count()
    if not fair:
        warnings.warn(f"sample weights must be known and between 0 and 1; those of {column} are ignored", stacklevel=2)
    return fair


def first_names(names: Sequence[str], n: int = 10) -> str:
    return ", ".join(map(str, names[:n])) + (f" and {len(names) - n} more" if len(names) > n else "")


def variables(df: DataFrame, given: Iterable[Variable | dict] = ()) -> list[Variable]:
    """Metadata of every column: what is given, completed and corrected by what the data show."""
    own = {v.name: v for v in (v if isinstance(v, Variable) else _from_row(v) for v in given)}
    for name in own.keys() - set(df.columns):
        warnings.warn(f"{name} is not a column; its metadata are ignored", stacklevel=2)
    out = []
    for r in profile(df).collect():
        name, n = r["variable"], r["n_distinct"]
        v = own.get(name)
        continuous = r["is_continuous"] if v is None or v.continuous is None else v.continuous
        if continuous and not r["is_numeric"]:
            warnings.warn(f"{name} is not numeric and is taken as discrete", stacklevel=2)
            continuous = False
        elif continuous and n <= 2:
            warnings.warn(f"{name} has {n} values and is taken as discrete", stacklevel=2)
            continuous = False
        elif continuous and n < CONTINUOUS_FROM:
            warnings.warn(f"{name} is continuous with {n} values only", stacklevel=2)
        elif not continuous and r["is_numeric"] and n >= 10:
            warnings.warn(f"{name} is numeric with {n} levels and taken as discrete", stacklevel=2)
        v = replace(v or Variable(name), continuous=bool(continuous))
        if v.levels:
            check_levels(df, v)
        if v.contextual and v.consequence:
            raise ValueError(f"{name} can't be both contextual and a consequence")
        out.append(v)
    return out


def surely_discrete(df: DataFrame, given: Iterable[Variable | dict]) -> bool:
    """Whether types and metadata alone say that no column is continuous."""
    own = dict((v.name, v.continuous is False) if isinstance(v, Variable) else (v.get("var_names"), v.get("var_type") == 0) for v in given)
    return all(own.get(c, False) for c in numeric_columns(df))


def _whole(row: dict, name: str, fair) -> int | None:
    """A whole number that ``fair`` accepts; anything else is ignored, with a warning."""
    value = row.get(name)
    if value is None or value != value:
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = float("nan")
    if not math.isfinite(number) or number != round(number) or not fair(number):
        warnings.warn(f"{name} of {row.get('var_names')} is incorrect and ignored: {value}", stacklevel=4)
        return None
    return int(number)


def _from_row(row: dict) -> Variable:
    """A row of a metadata table; missing or unknown entries take their defaults."""
    get = row.get
    order = get("levels_increasing_order")
    layers = _whole(row, "n_layers", lambda v: v >= 1)
    delta, average = _whole(row, "delta_t", lambda v: v >= 0), _whole(row, "mov_avg", lambda v: v == 0 or v >= 2)
    return Variable(
        get("var_names"), None if get("var_type") not in (0, 1) else bool(get("var_type")), bool(get("is_contextual") or 0), bool(get("is_consequence") or 0),
        tuple(x.strip() for x in order.split(",")) if order else None, get("group"), get("group_color"), layers, delta, average,
    )


def check_levels(df: DataFrame, v: Variable) -> tuple[list[str], list[str]]:
    """(levels that the data lack, the first values that the order lacks); the latter become unknown with the order."""
    listed = df.sparkSession.createDataFrame([(x,) for x in v.levels], "level_ string")
    values = df.select(F.col(v.name).cast("string").alias("level_")).where(F.col("level_").isNotNull()).distinct()
    unused = sorted(r[0] for r in listed.join(values, "level_", "left_anti").collect())
    outside = values.join(F.broadcast(listed), "level_", "left_anti")  # the caller's own list
    unknown = [r[0] for r in outside.orderBy("level_").limit(1000).collect()]
    if unknown:
        warnings.warn(f"{v.name}: values outside the given order: {first_names(unknown)}", stacklevel=2)
    return unused, unknown


def canonical_pairs(pairs: DataFrame, known: Sequence[str] | None = None, x: str = "var1", y: str = "var2", lag: str | None = None) -> DataFrame:
    """Pairs in name order, once each; unknown names and self pairs (without a lag) go."""
    p = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if known is not None:
        p = p.where(F.col(x).isin(*known) & F.col(y).isin(*known))
    if lag is None:
        p = p.where(F.col(x) != F.col(y)).select(F.least(x, y).alias(x), F.greatest(x, y).alias(y))
        return p.dropDuplicates([x, y])
    p = p.where((F.col(x) != F.col(y)) | (F.col(lag) > 0))
    swap = (F.coalesce(F.col(lag), F.lit(0)) == 0) & (F.col(x) > F.col(y))
    return p.select(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x), F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y), lag).dropDuplicates([x, y, lag])


def without_pairs(edges: DataFrame, black_box: DataFrame, x: str = "x", y: str = "y", bx: str = "var1", by: str = "var2") -> DataFrame:
    """Edges that the list does not forbid, in either direction."""
    listed = black_box.select(F.least(bx, by).alias("a_"), F.greatest(bx, by).alias("b_"))
    return edges.join(listed, (F.least(x, y) == F.col("a_")) & (F.greatest(x, y) == F.col("b_")), "left_anti")


def complete_case_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, n): rows in which both are known, for every pair, in one aggregation."""
    one = df.agg(*(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias(f"n{i}") for i, (x, y) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n")) for i, (x, y) in enumerate(pairs)))).alias("r")).select("r.*")


@dataclass(frozen=True)
class Options:
    """Parameters of a reconstruction, checked."""

    cplx: str = "nml"
    orientation: bool = True
    ort_proba_ratio: float = 1.0
    ort_consensus_ratio: float | None = None
    propagation: bool = False
    latent: str = "orientation"
    n_eff: int = -1
    sample_weights: str | None = None
    n_shuffles: int = 0
    conf_threshold: float = 0.0
    test_mar: bool = True
    consistent: str = "no"
    max_iteration: int = 100
    consensus_threshold: float = 0.8
    negative_info: bool = False
    mode: str = "S"
    seed: int = 42

    def __post_init__(self):
        for name, allowed in (("cplx", ("nml", "bic")), ("latent", ("orientation", "yes", "no")), ("consistent", ("no", "orientation", "skeleton")), ("mode", ("S", "TS"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        for name in ("ort_proba_ratio", "consensus_threshold", "conf_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if (self.n_shuffles > 0) != (self.conf_threshold > 0):
            warnings.warn("n_shuffles and conf_threshold act together; the confidence cut is off", stacklevel=2)
            object.__setattr__(self, "n_shuffles", 0)
            object.__setattr__(self, "conf_threshold", 0.0)
        if self.ort_consensus_ratio is None:
            object.__setattr__(self, "ort_consensus_ratio", self.ort_proba_ratio)
        if not 0 <= self.ort_consensus_ratio <= 1:
            raise ValueError("ort_consensus_ratio must lie between 0 and 1")
        if self.n_eff != -1 and self.n_eff <= 0:
            raise ValueError("n_eff must be positive, or -1 for the number of rows")
        if self.max_iteration < 1 or self.n_shuffles < 0:
            raise ValueError("max_iteration must be at least 1 and n_shuffles at least 0")

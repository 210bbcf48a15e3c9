"""What the operators share: durable intermediate tables, shared files, joins and sums that hold up
against hot keys, graph components.

Intermediate results are written as Parquet in the folder that the cluster names in
``spark.checkpoint.dir``: every executor and the driver reach it, so a lost executor costs a
recomputation of its own task at most, and later plans see true sizes.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalnet.plans.shipping import ship

DIR_KEY = "spark.checkpoint.dir"
__all__ = ["SPACE", "WORD", "beside", "connected_components", "delete", "durable", "first_by_hash", "fresh", "join_back", "lookup", "made", "new_folder", "open_fs", "release", "row_hash", "running", "shared_dir", "ship"]
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot that holds more than one in so many of all rows, so there are fewer hot keys than this.
HOT = 1000
#: Rows that may share a task whatever their key.
FEW = 1000
#: Bytes of a table that is sent to every executor.
BROADCAST = 16 << 20
#: Rows of a range in running sums.
RANGE = 1 << 20
#: Edges that one task joins to components.
SMALL_GRAPH = 20_000
_own_dir: list[str] = []
#: URIs of the durable tables of this process, oldest first.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A URI that all executors share. Only in local mode, where the executor is this process, may a
    temporary folder of this machine serve; on a cluster that names no folder this is an error."""
    uri = spark.sparkContext.getConf().get(DIR_KEY) or spark.conf.get(DIR_KEY, None)
    if not uri:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{DIR_KEY} must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="shared-"))
        uri = f"file://{_own_dir[0]}"
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return uri.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss. Each value of
    the column ``by`` gets a folder of its own, so that a part can be deleted alone."""
    spark = df.sparkSession
    to = new_folder(spark, name)
    made.append(to)
    (df.write.partitionBy(by) if by else df.write).parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def delete(spark: SparkSession, uris: Sequence[str]) -> None:
    """Remove durable tables that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(conf).delete(path, True)
        if uri in made:
            made.remove(uri)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of queries that have ended, all of whose results are durable
    by now: Spark does so when the driver's collector finds that nothing refers to them. It holds on to the
    last job's plan, so an empty job comes first."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows among which are the ``n`` of least ``key``, a 64-bit hash: a fifth more than n are expected, so
    that a sort with a limit of n afterwards does not send n rows from every task."""
    total = df.count()
    if total <= n:
        return df
    return df.where(F.col(key) <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(1.2 * n / total * (1 << 64)))))


def open_fs(uri: str):
    """(filesystem, path) of a shared URI, for files that Spark's own writers do not make."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` (a durable table) joined to ``table``, which has one row for each key; ``how`` is inner or left.

    A key may hold any share of the rows. The hot ones, fewer than ``HOT`` by definition, meet a
    broadcast copy of their rows of the table where they lie; only the others are shuffled by key.
    ``counts`` (keys, n), if already known, has the rows of each key. Null keys match nothing."""
    keys = list(keys)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    limit = max(FEW, rows.count() // HOT)
    hot = durable(counts.where(F.col("n") > limit).select(*keys).dropna(), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    here = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(here, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(table, keys, how))


def beside(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to a durable table with a row for each key. The table is broadcast if its rows, written as text, take
    at most ``BROADCAST`` bytes; otherwise keys are looked up like any others."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).collect()[0][0] or 0
    return rows.join(F.broadcast(table), key, "left") if size <= BROADCAST else lookup(rows, table, [key], "left")


def running(df: DataFrame, order: Sequence[str], amounts: dict[str, str], name: str) -> DataFrame:
    """``df`` as a durable table, range-sorted by ``order``, with running sums over the whole of it.

    ``amounts`` maps each new column to the whole-number expression that it sums, its own row included.
    Ranges hold about ``RANGE`` rows; a task sums within one, and one row a range is summed between."""
    (part,) = fresh(df, "part")
    df = df if df.count() <= RANGE else durable(df, name)
    n = -(-max(1, df.count()) // RANGE)
    dealt = durable(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), name)
    sums = dealt.groupBy(part).agg(*(F.sum(F.expr(e)).alias(c) for c, e in amounts.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = durable(sums.select(part, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in amounts)), name)
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({c: F.sum(F.expr(e)).over(inside) for c, e in amounts.items()}).join(F.broadcast(sums), part)  # a row a range
    return out.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in amounts}).drop(part, *(f"{c}_before" for c in amounts))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a graph of at most ``SMALL_GRAPH`` edges: every node and the least of its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            p, q = top(u), top(v)
            up[max(p, q)] = min(p, q)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(top, nodes)), pa.int64())], ["node", "to"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), longs; component is the least node.

    Rounds of contraction: every node joins that one of itself and its neighbours whose hash, other in
    each round, is least; edges are renamed, loops and repeats go. The number of edges falls by a
    constant factor a round, so all rounds together cost a few times the first; what is left at
    ``SMALL_GRAPH`` edges one task joins. Then the names are followed from the last round back to the
    first. Hubs are met by ``lookup`` and by partial aggregation; only counts reach the driver."""
    long = lambda c: F.col(c).cast("long")
    now = durable(edges.select(F.least(long(a), long(b)).alias("u"), F.greatest(long(a), long(b)).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links")
    steps: list[tuple[DataFrame, bool]] = []
    while n := now.count():
        if n <= SMALL_GRAPH:
            steps.append((durable(now.coalesce(1).mapInArrow(_joined, "node long, to long"), "contraction"), False))
            break
        order = lambda c, k=len(steps): F.xxhash64(F.lit(k), F.col(c))
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o"), F.lit(1).alias("l")), F.struct(F.col("v").alias("n"), F.col("u").alias("o"), F.lit(0).alias("l")))).alias("e")).select("e.*")
        near = ends.groupBy("n").agg(F.min(F.struct(order("o").alias("h"), F.col("o").alias("w"))).alias("m"), F.sum("l").alias("nu"), F.sum(1 - F.col("l")).alias("nv"))
        step = durable(near.select(F.col("n").alias("node"), F.least(F.col("m"), F.struct(order("n").alias("h"), F.col("n").alias("w")))["w"].alias("to"), "nu", "nv"), "contraction")
        hubs = step.agg(F.max(F.col("nu") + F.col("nv"))).collect()[0][0] > max(FEW, n // HOT)
        steps.append((step, hubs))
        for old, new, size in (("u", "p", "nu"), ("v", "q", "nv")):
            names = step.select(F.col("node").alias(old), F.col("to").alias(new))
            now = lookup(durable(now, "links"), names, [old], counts=step.select(F.col("node").alias(old), F.col(size).alias("n"))) if hubs else now.join(names, old)
        now = durable(now.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).where("u <> v").distinct(), "links")
    if not steps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    known = steps[-1][0].select("node", F.col("to").alias("root"))
    for step, hubs in reversed(steps[:-1]):
        roots = known.select(F.col("node").alias("to"), "root")
        found = lookup(step.select("node", "to"), roots, ["to"], "left") if hubs else step.join(roots, "to", "left")
        known = found.select("node", F.coalesce("root", "to").alias("root"))
    known = durable(known, "names")
    return lookup(known, known.groupBy("root").agg(F.min("node").alias("component")), ["root"]).select("node", "component")


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row: with its id, what tells rows apart that are not equal."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def join_back(docs: DataFrame, rows: DataFrame, how: str, id_col: str = "doc_id", once: bool = False) -> DataFrame:
    """``docs`` semi- or anti-joined to rows of (id, th), th being the ``row_hash``; null ids match null ids.

    With ``once``, of equal rows one stays."""
    i, no, th = keys = fresh(docs, "id", "no", "th")
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), no: F.col(id_col).isNull(), th: row_hash(docs)})
    other = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias(i), F.col("id").isNull().alias(no), F.col("th").alias(th))
    out = keyed.join(other, keys, how)
    return (out.dropDuplicates(keys) if once else out).drop(*keys)

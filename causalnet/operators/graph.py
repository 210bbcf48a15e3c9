"""Small-graph logic on the driver (its size is the number of variables), and edge-table operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.functions.scores import accepted_head, adjacency_code
from causalnet.plans.shipping import ship

#: Neighbours of one node that meet those of another block in one group.
BLOCK = 1024


def neighbours(edges: Iterable[tuple[int, int]]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for x, y in edges:
        out.setdefault(x, set()).add(y)
        out.setdefault(y, set()).add(x)
    return out


def blocks(adjacent: dict[int, set[int]]) -> list[frozenset[int]]:
    """Biconnected components as node sets (bridges are pairs), by an iterative depth-first search."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    found: list[frozenset[int]] = []
    for root in sorted(adjacent):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, trail = [(root, None, iter(sorted(adjacent[root])))], []
        while stack:
            v, parent, todo = stack[-1]
            for u in todo:
                if u not in order:
                    order[u] = low[u] = len(order)
                    trail.append((v, u))
                    stack.append((u, v, iter(sorted(adjacent[u]))))
                    break
                if u != parent and order[u] < order[v]:
                    trail.append((v, u))
                    low[v] = min(low[v], order[u])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= order[parent]:
                        nodes: set[int] = set()
                        while trail:
                            e = trail.pop()
                            nodes.update(e)
                            if e == (parent, v):
                                break
                        found.append(frozenset(nodes))
    return found


def on_paths(adjacent: dict[int, set[int]], x: int, y: int) -> set[int]:
    """Nodes that lie on some simple path from x to y: those of the blocks between them."""
    own = blocks(adjacent)
    at: dict[int, list[int]] = {}
    for i, b in enumerate(own):
        for v in b:
            at.setdefault(v, []).append(i)
    if x not in at or y not in at:
        return set()
    todo, via = deque([("v", x)]), {("v", x): None}
    while todo:
        kind, k = node = todo.popleft()
        if node == ("v", y):
            break
        for nxt in ([("b", i) for i in at[k]] if kind == "v" else [("v", v) for v in own[k]]):
            if nxt not in via:
                via[nxt] = node
                todo.append(nxt)
    node, out = ("v", y), set()
    while node in via and node is not None:
        if node[0] == "b":
            out |= own[node[1]]
        node = via[node]
    return out - {x, y}


class CycleTracker:
    """Tells when an iteration's graph has been seen before; the cycle is what lies between."""

    def __init__(self):
        self.seen: dict[frozenset, int] = {}
        self.graphs: list[frozenset] = []

    def add(self, graph: Iterable) -> list[frozenset] | None:
        g = frozenset(graph)
        if g in self.seen:
            return self.graphs[self.seen[g] :]
        self.seen[g] = len(self.graphs)
        self.graphs.append(g)
        return None


def _both_ways(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(a, z): each edge of two known ends in both directions, once."""
    known = edges.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    return known.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("z")), F.struct(F.col("y").alias("a"), F.col("x").alias("z")))).alias("e")).select("e.*").distinct()


def _triangles(near: DataFrame) -> DataFrame:
    """(z, a, b): a < b are joined and both stand beside z. Each triangle is found from its node of least degree, so that no
    node's pairs of neighbours are all formed; it stands here three times, once for each z."""
    degree = near.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    rank = lambda d, v: F.struct(F.col(d), F.col(v))
    ranked = near.join(degree, "a").withColumnRenamed("d", "da").join(degree.select(F.col("a").alias("z"), F.col("d").alias("dz")), "z")
    up = ranked.where(rank("da", "a") < rank("dz", "z")).select("a", "z", "dz")
    wedges = up.select("a", F.col("z").alias("u"), F.col("dz").alias("du")).join(up.select("a", F.col("z").alias("v"), F.col("dz").alias("dv")), "a").where(rank("du", "u") < rank("dv", "v")).select("a", "u", "v")
    closed = wedges.join(near.select(F.col("a").alias("u"), F.col("z").alias("v")), ["u", "v"], "left_semi")
    three = F.array(*(F.struct(F.col(p).alias("z"), F.least(q, r).alias("a"), F.greatest(q, r).alias("b")) for p, q, r in (("a", "u", "v"), ("u", "a", "v"), ("v", "a", "u"))))
    return closed.select(F.explode(three).alias("t")).select("t.*")


def unshielded_triples(edges: DataFrame, x: str = "x", y: str = "y", block: int = BLOCK) -> DataFrame:
    """(x, z, y): x - z - y are edges and x - y is not, x < y.

    The neighbours of a node are dealt to blocks of about ``block``, and each two blocks meet in a group of their own, so that no
    task has all pairs of a node of many neighbours. Pairs that are joined are known from the triangles, so that the others,
    which are as many as the result, are formed and passed on without a shuffle of theirs."""
    near = _both_ways(edges, x, y).where("a <> z")  # a loop is part of no triple
    count = near.groupBy("z").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    place = lambda v: F.pmod(F.xxhash64(v), F.col("blocks")).cast("int")
    dealt = near.join(count, "z").withColumn("own", place("a"))
    closed = _triangles(near).join(count, "z").withColumn("j", place("b")).groupBy("z", "a", "j").agg(F.collect_set("b").alias("joined"))
    # a meets the others of each block j; those of smaller names are left out there, so a pair is formed once
    left = dealt.select("z", "a", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).join(closed, ["z", "a", "j"], "left")
    right = dealt.select("z", F.col("a").alias("b"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(tasks, "z", "own", "j").hint("merge").join(right.repartition(tasks, "z", "own", "j"), ["z", "own", "j"])
    pairs = met.where((F.col("a") < F.col("b")) & (F.col("joined").isNull() | ~F.array_contains("joined", F.col("b"))))
    return pairs.select(F.col("a").alias("x"), "z", F.col("b").alias("y"))


def edges_outside_triples(edges: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """Edges that are part of no triple: of ``triples`` (x, z, y), or of the graph's own unshielded ones.

    The latter are not formed: an edge is part of none if and only if its two ends, with themselves, have the same neighbours. Sets
    of neighbours are told apart by their size and the sums of two 64-bit hashes, so no row grows with a node's degree."""
    if triples is not None:
        used = triples.select(F.least("x", "z").alias("u"), F.greatest("x", "z").alias("v")).unionByName(triples.select(F.least("y", "z").alias("u"), F.greatest("y", "z").alias("v"))).distinct()
        return edges.join(used, (F.least("x", "y") == F.col("u")) & (F.greatest("x", "y") == F.col("v")), "left_anti")
    near = _both_ways(edges)
    closed = near.where("a <> z").unionByName(near.select("a", F.col("a").alias("z")).distinct())
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    sets = closed.groupBy("a").agg(F.struct(F.count(F.lit(1)).alias("n"), total("z").alias("h"), total(F.lit(1), "z").alias("g")).alias("s"))
    ends = edges.join(sets.select(F.col("a").alias("x_"), F.col("s").alias("sx_")), F.col("x") == F.col("x_"), "left").join(sets.select(F.col("a").alias("y_"), F.col("s").alias("sy_")), F.col("y") == F.col("y_"), "left")
    return ends.where(F.col("x").isNull() | F.col("y").isNull() | (F.col("sx_") == F.col("sy_"))).select(*edges.columns)


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("x", "y")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def multi_edges(edges: DataFrame) -> DataFrame:
    """Pairs of nodes with more than one edge."""
    return edges.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("n_edges")).where("n_edges > 1")


def merged_tips(tips: DataFrame, *by: str, p: str = "p") -> DataFrame:
    """Of the probabilities that triples give a tip, the one furthest from one half (the higher in a tie)."""
    best = tips.groupBy(*by).agg(F.max(F.struct(F.round(F.abs(F.col(p) - 0.5), 12).alias("d"), F.col(p).alias("p"))).alias("b"))
    return best.select(*by, F.col("b.p").alias(p))


def with_adjacency(edges: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Adds tip_x, tip_y and adj from p_x, p_y, the probabilities of a head at x and at y (null: tail)."""
    tip = lambda p: F.when(accepted_head(F.col(p), ratio), 2).otherwise(1)
    out = edges.withColumn("tip_x", tip("p_x")).withColumn("tip_y", tip("p_y"))
    return out.withColumn("adj", adjacency_code(F.col("tip_x"), F.col("tip_y")))


def genuine_causes(edges: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Adds is_causal: a sure head at one end and a sure tail at the other."""
    one = lambda head, tail: F.coalesce(((1 - F.col(head)) / F.nullif(F.col(head), F.lit(0.0)) < ratio) & (F.col(tail) / F.nullif(1 - F.col(tail), F.lit(0.0)) < ratio), F.lit(False))
    flag = F.when(F.col("adj") == 2, one("p_y", "p_x")).when(F.col("adj") == -2, one("p_x", "p_y")).otherwise(F.lit(False))
    return edges.withColumn("is_causal", flag)


def edge_statistics(history: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per edge over the iterations of a cycle: how often each code, as text, and whether it is kept.

    ``history`` has x, y, iteration, adj."""
    total = history.groupBy("x", "y").agg(F.count(F.lit(1)).alias("total"))
    each = history.groupBy("x", "y", "adj").agg(F.count(F.lit(1)).alias("c")).join(total, ["x", "y"])
    share = F.concat(F.round(100 * F.col("c") / F.col("total")).cast("int").cast("string"), F.lit("%("), F.col("adj").cast("string"), F.lit(")"))
    g = each.groupBy("x", "y").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), F.col("adj").alias("a"), share.alias("s")))), lambda e: e["s"]), ";").alias("edge_stats"),
        F.coalesce(F.max(F.when(F.col("adj") == 0, F.col("c") / F.col("total"))), F.lit(0.0)).alias("f0"),
    )
    return g.select("x", "y", "edge_stats", ((F.col("f0") == 0) | (F.col("f0") < 1 - threshold)).alias("connected"))


def average_probability(history: DataFrame) -> DataFrame:
    return history.groupBy("x", "y").agg(F.avg(F.when(F.col("p") != -1, F.col("p"))).alias("p"))


def consensus_orientation(edges: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Adds ort_consensus and is_causal_consensus from p_y2x and p_x2y, the average probabilities of a head at
    x and at y; 1 where neither is sure. An unknown probability is never sure."""
    sure = lambda p: F.coalesce((F.col(p) > 0) & (1 - F.col(p) < ratio * F.col(p)), F.lit(False))
    tail = lambda p: F.coalesce((F.col(p) < 1) & (F.col(p) < ratio * (1 - F.col(p))), F.lit(False))
    x, y = sure("p_y2x"), sure("p_x2y")
    code = F.when(x & y, 6).when(y, 2).when(x, -2).otherwise(1)
    return edges.withColumn("ort_consensus", code).withColumn("is_causal_consensus", (~x & y & tail("p_y2x")) | (x & ~y & tail("p_x2y")))


def truth_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, fscore, of pairs without direction."""
    key = lambda d: d.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    j = key(found).withColumn("f", F.lit(1)).join(key(truth).withColumn("t", F.lit(1)), ["x", "y"], "full")
    c = j.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("fscore"))


def path_candidates(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, between): the nodes on simple paths from x to y, by name, as text. Edges of a graph of variables, whose nodes the
    driver holds as a list of neighbours; pairs stay where they are and each is answered from a broadcast copy of that list."""
    near = neighbours((r["x"], r["y"]) for r in edges.select("x", "y").distinct().collect())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array([",".join(sorted(on_paths(near, p, q))) for p, q in zip(x, y)])], ["x", "y", "between"])

    ship(edges.sparkSession)
    return pairs.select("x", "y").mapInArrow(run, "x string, y string, between string")


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """Nodes that a path joins to ``start``: rounds of joins until nothing is new."""
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start,)], "node string")
    n = 1
    while True:
        more = seen.unionByName(both.join(seen, F.col("x") == F.col("node")).select(F.col("y").alias("node"))).distinct().checkpoint()
        if (m := more.count()) == n:
            return more
        seen, n = more, m

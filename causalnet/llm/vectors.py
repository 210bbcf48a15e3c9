"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves, and each half has a codebook of its own; the pairs of codewords are the cells
of a product grid. A vector lies in the cell of its nearest codewords, and visits cells in the order of the multi-sequence
traversal: by growing sum of the two squared distances, until the sum exceeds the nearest cell's by ``slack``.
A pair is found if either of the two visits the other's cell; found pairs are verified by their cosine in double precision.

The slack is calibrated, not a number of cells: around a bounded sample of vectors partners are drawn at the
very threshold (nearer ones are easier to find), and the slack is the least by which ``recall`` of them are
found. ``measured_recall`` holds the index against brute force. Codebooks are fitted to a bounded sample (``SAMPLE``
vectors of least hash) from which all that link to an earlier one are left out, so that a large group of copies
can't draw codewords to itself. Every vector is indexed.

Equal vectors are counted once, with their number. Cells are dealt to shelves of about ``SHELF`` vectors, neighbours
together; a vector is sent once to each shelf that it visits, however many cells of it. A cell of more
vectors is cut into chunks, each a shelf of its own. A task holds one shelf and streams its visitors past it; it returns
sums of links for each vector and a spanning forest of the links that it saw, never the pairs themselves.

Defined cases: vectors that are null, of length zero, or hold a null or non-finite component link with nothing
and are kept; a shorter vector counts as filled up with zeros; one of a single component too. Vectors with a null id link and count like
others; a component's id is its least id (null if it has none), and a vector is kept if that is its own. Repeated
rows repeat, and are links of each other. Extra columns of any name are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import connected_components, durable, first_by_hash, lookup, ship

THRESHOLD = 0.95
#: Part of the pairs at the threshold that the traversal is to find.
RECALL = 0.99
#: Vectors that the codebooks and the slack are fitted to.
SAMPLE = 4096
#: Vectors expected in a cell, and the most codewords of a half.
CELL = 8
MOST_WORDS = 1024
#: Vectors of a shelf, and of a chunk of a cell that is larger than a shelf.
SHELF = 4096
CHUNK = 16384
ROUNDS = 12


@dataclass
class Index:
    """Two codebooks (words x dimensions of the half) and the slack of the traversal."""

    books: tuple[np.ndarray, np.ndarray]
    slack: float

    @property
    def half(self) -> int:
        return self.books[0].shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to each codeword, less the squared length of the half."""
        return tuple((c**2).sum(axis=1) - 2 * h @ c.T for h, c in zip((x[:, : self.half], x[:, self.half :]), self.books))

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): what the traversal of each row visits, by row and by growing distance.

        Only codewords within the slack of the nearest can be part of such a cell; their sums are taken for
        all rows at once, which gives the cells that ``multi_sequence`` gives one by one."""
        excess = [d - d.min(axis=1, keepdims=True) for d in self.distances(x)]
        (r, i), (q, j) = (np.nonzero(e <= self.slack) for e in excess)
        own = np.bincount(q, minlength=len(x))
        first = np.cumsum(own) - own
        times = own[r]
        left = np.repeat(np.arange(len(r)), times)
        right = first[r[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        rows, total = r[left], excess[0][r[left], i[left]] + excess[1][r[left], j[right]]
        near = total <= self.slack
        rows, cells, total = rows[near], (i[left] * len(self.books[1]) + j[right])[near], total[near]
        order = np.lexsort((cells, total, rows))
        return rows[order], cells[order]


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) by growing a[i] + b[j]: a queue holds the front of the pairs of sorted places."""
    p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    queue, seen = [(float(a[p[0]] + b[q[0]]), 0, 0)], {(0, 0)}
    while queue:
        s, i, j = heapq.heappop(queue)
        yield s, int(p[i]), int(q[j])
        for k in ((i + 1, j), (i, j + 1)):
            if k[0] < len(p) and k[1] < len(q) and k not in seen:
                seen.add(k)
                heapq.heappush(queue, (float(a[p[k[0]]] + b[q[k[1]]]), *k))


def unit(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of length one, in double precision, filled up with zeros; scaled first, so that no square overflows."""
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < np.asarray(sizes)[:, None]] = flat
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out


def codebook(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a word that nothing is nearest to stays where it is."""
    words = min(words, len(x))
    c = x[rng.choice(len(x), words, replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=words)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    # In an order in which neighbours are near: each word is followed by the nearest that is left.
    order, left = [0], list(range(1, words))
    while left:
        order.append(left.pop(int(((c[left] - c[order[-1]]) ** 2).sum(axis=1).argmin())))
    return c[order]


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 42) -> Index:
    """The index of ``n`` vectors, from unit rows of a sample of them."""
    rng = np.random.default_rng(seed)
    keep = np.ones(len(sample), bool)
    for s in range(0, len(sample), 512):  # of rows that link, the first stays
        close = sample[s : s + 512] @ sample.T >= threshold
        keep[s : s + 512] = ~(close & (np.arange(len(sample)) < np.arange(s, s + len(close))[:, None])).any(axis=1)
    x, half = sample[keep], sample.shape[1] // 2
    words = int(np.clip(round((n / CELL) ** 0.5), 1, MOST_WORDS))
    index = Index(tuple(codebook(h, words, rng) for h in (x[:, :half], x[:, half:])), 0.0)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((aside**2).sum(axis=1, keepdims=True))
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * aside / np.maximum(length, 1e-300)
    index.slack = float(np.quantile(np.minimum(_excess(index, x, y), _excess(index, y, x)), recall)) + 1e-12
    return index


def _excess(index: Index, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much the cell of each y is farther from its x than x's own cell."""
    (a, b), (p, q) = index.distances(x), index.distances(y)
    at = np.arange(len(x))
    return a[at, p.argmin(axis=1)] - a.min(axis=1) + b[at, q.argmin(axis=1)] - b.min(axis=1)


def shelves(counts: np.ndarray, shelf: int = SHELF, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first shelf, number of shelves) of each cell; cells follow each other, a cell over ``shelf`` stands alone."""
    first, many, now, filled = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for c, n in enumerate(counts.tolist()):
        if filled and filled + n > shelf:
            now, filled = now + 1, 0
        first[c] = now
        if n > shelf:
            many[c] = max(1, -(-n // chunk))
            now, filled = now + int(many[c]), 0
        else:
            filled += n
    return first, many


def _finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, k1, k2) of the rows whose vectors have a direction; the keys are two hashes of the vector."""
    v = F.col(vec_col)
    if dict(rows.dtypes)[vec_col] != "array<float>":
        v = v.cast("array<double>")
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(_finite(F.col("v")))
    return out.withColumns({"k1": F.xxhash64(F.lit(1), "v"), "k2": F.xxhash64(F.lit(2), "v")})


def _lists(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows of a column of lists."""
    return unit(column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), width)


def _placed(index: Index, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(index.cell(_lists(b.column("v"), width)), pa.int64())], ["cell"])

    return run


def _sent(index: Index, width: int, full: np.ndarray, first: np.ndarray, many: np.ndarray):
    """A row for each shelf that a vector visits; ``own`` on the one where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2048) for i in range(0, len(whole), 2048)):
                x = _lists(b.column("v"), width)
                rows, cells = index.visits(x)
                some = full[cells]
                rows, cells = rows[some], cells[some]
                mine = index.cell(x)
                node = b.column("node").to_numpy()
                home = first[mine] + node % many[mine]
                ends = np.cumsum(np.bincount(rows, minlength=len(b)))
                visited = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(cells, pa.int32()))
                # One pair (row, shelf) for each chunk of each visited cell, then once each.
                n = many[cells]
                r = np.repeat(rows, n)
                shelf = np.repeat(first[cells], n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                r, shelf = np.unique(np.stack([r, shelf], axis=1), axis=0).T if len(r) else (r, shelf)
                take = pa.array(r)
                columns = [pa.array(shelf, pa.int64()), pa.array(shelf == home[r]), b.column("node").take(take), b.column("n").take(take), pa.array(mine[r], pa.int32()), visited.take(take), b.column("v").take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["shelf", "own", "node", "n", "cell", "cells", "v"])

    return run


def spread(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label of each component of the links (u, v) over places; rounds of hooking and halving."""
    if not len(u):
        return label
    values, label = np.unique(label, return_inverse=True)
    up = np.arange(len(values))
    a, b = label[u], label[v]
    while True:
        p, q = up[a], up[b]
        apart = p != q
        if not apart.any():
            return values[up[label]]
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]


class _Shelf:
    """The vectors of one shelf by cell, and what has been found of them so far."""

    def __init__(self, rows: list[pa.RecordBatch], width: int):
        t = pa.Table.from_batches(rows).combine_chunks()
        col = lambda c: t.column(c).chunk(0)
        order = np.argsort(col("cell").to_numpy(), kind="stable")
        self.x = _lists(col("v"), width)[order]
        self.node, self.n, self.cell = (col(c).to_numpy()[order] for c in ("node", "n", "cell"))
        size, flat = np.diff(col("cells").offsets.to_numpy()), col("cells").flatten().to_numpy()
        visit = np.full((len(order), int(size.max(initial=1))), -1, np.int64)
        visit[np.repeat(np.arange(len(order)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        self.visit = visit[order]
        cells, start = np.unique(self.cell, return_index=True)
        self.span = dict(zip(cells.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(order)])))
        self.links, self.label = np.zeros(len(order), np.int64), self.node.copy()

    def meet(self, b: pa.RecordBatch, width: int, threshold: float) -> pa.RecordBatch:
        """Sums and a forest of the links of a batch of visitors."""
        x, node, n, cell = _lists(b.column("v"), width), *(b.column(c).to_numpy() for c in ("node", "n", "cell"))
        got = np.zeros(len(node), np.int64)
        flat, size = b.column("cells").flatten().to_numpy(), np.diff(b.column("cells").offsets.to_numpy())
        rows = np.repeat(np.arange(len(node)), size)
        here = np.isin(flat, np.fromiter(self.span, np.int64))
        rows, flat = rows[here], flat[here]
        order = np.argsort(flat, kind="stable")
        rows, flat = rows[order], flat[order]
        before, label = self.label.copy(), node.copy()
        cells, starts = np.unique(flat, return_index=True)
        for c, s, e in zip(cells.tolist(), starts.tolist(), [*starts[1:].tolist(), len(flat)]):
            low, high = self.span[c]
            who = rows[s:e]
            for k in range(0, len(who), 1024):
                part = who[k : k + 1024]
                i, j = np.nonzero(x[part] @ self.x[low:high].T >= threshold)
                i, j = part[i], j + low
                apart = node[i] != self.node[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    continue
                np.add.at(got, i, self.n[j])
                # If the other one does not visit back, nobody else counts this link for it.
                back = (self.visit[j] == cell[i][:, None]).any(axis=1)
                np.add.at(self.links, j[~back], n[i[~back]])
                places = spread(j, len(self.label) + i, np.concatenate([self.label, label]))
                self.label, label = places[: len(self.label)], places[len(self.label) :]
        new, old = label < node, self.label < before
        some = got > 0
        a = np.concatenate([node[some], node[new], self.node[old]])
        to = np.concatenate([np.full(some.sum(), -1), label[new], self.label[old]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(to, pa.int64()), pa.array(np.concatenate([got[some], np.zeros(new.sum() + old.sum(), np.int64)]), pa.int64())], ["node", "to", "links"])

    def close(self) -> pa.RecordBatch:
        some = self.links > 0
        return pa.RecordBatch.from_arrays([pa.array(self.node[some], pa.int64()), pa.array(np.full(some.sum(), -1), pa.int64()), pa.array(self.links[some], pa.int64())], ["node", "to", "links"])


def _compared(width: int, threshold: float):
    """Rows come by shelf, those that lie on it first. A vector on a shelf is also a visitor there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, shelf = None, [], None
        for whole in batches:
            ids = whole.column("shelf").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                b = whole.slice(s, e - s)
                if ids[s] != at:
                    if waiting:
                        shelf, waiting = yield from _opened(waiting, width, threshold)
                    if shelf:
                        yield shelf.close()
                    at, shelf, waiting = ids[s], None, []
                own = b.column("own").to_numpy(zero_copy_only=False)
                k = int(own.sum())
                if k:
                    waiting.append(b.slice(0, k))
                if k < len(b):
                    if waiting:
                        shelf, waiting = yield from _opened(waiting, width, threshold)
                    if shelf:
                        yield shelf.meet(b.slice(k), width, threshold)
        if waiting:
            shelf, waiting = yield from _opened(waiting, width, threshold)
        if shelf:
            yield shelf.close()

    return run


def _opened(rows: list[pa.RecordBatch], width: int, threshold: float):
    shelf = _Shelf(rows, width)
    for b in rows:
        yield shelf.meet(b, width, threshold)
    return shelf, []


def prepared(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """((node, k1, k2, n, id, v) with a row per different vector, durable, and the longest vector's even length)."""
    good = usable(rows, id_col, vec_col)
    each = good.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.any_value("v").alias("v"))
    each = durable(each.withColumn("node", F.monotonically_increasing_id()), "vectors")  # ids are fixed once written
    longest = each.agg(F.max(F.size("v"))).collect()[0][0] or 2
    return each, max(2, longest + longest % 2)


def index_of(each: DataFrame, width: int, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> Index:
    return fit(_least(each, sample, width)[1], each.count(), threshold, recall)


def _least(each: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and unit rows of the ``n`` vectors of least hash."""
    some = first_by_hash(each.select("k1", "k2", "node", "v"), "k1", n).orderBy("k1", "k2").limit(n).collect()
    sizes = np.array([len(r["v"]) for r in some], np.int64)
    return np.array([r["node"] for r in some], np.int64), unit(np.array([c for r in some for c in r["v"]], np.float64), sizes, width)


def links(each: DataFrame, index: Index, width: int, threshold: float = THRESHOLD, shelf: int = SHELF, chunk: int = CHUNK) -> DataFrame:
    """(node, to, links), durable: rows of a forest of the links where ``to`` is not -1, else parts of a node's sum of links."""
    spark = each.sparkSession
    ship(spark)
    full = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)  # at most MOST_WORDS^2
    placed = each.select("v").mapInArrow(_placed(index, width), "cell long").groupBy("cell").count().toPandas()
    full[placed["cell"].to_numpy()] = placed["count"].to_numpy()
    first, many = shelves(full, shelf, chunk)
    kind = dict(each.dtypes)["v"]
    sent = each.select("node", "n", "v").mapInArrow(_sent(index, width, full > 0, first, many), f"shelf long, own boolean, node long, n long, cell int, cells array<int>, v {kind}")
    n = int(first[-1] + many[-1])
    dealt = sent.repartition(max(1, min(n, 20_000)), "shelf").sortWithinPartitions("shelf", F.desc("own"))
    return durable(dealt.mapInArrow(_compared(width, threshold), "node long, to long, links long"), "vector-links")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: other vectors of at least ``threshold`` cosine that were found, and the
    least id that links lead to."""
    each, width = prepared(rows, id_col, vec_col)
    own = F.col(id_col).cast("long")
    lone = rows.where(~F.coalesce(_finite(F.col(vec_col)), F.lit(False))).select(own.alias("id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    if each.isEmpty():
        return lone.withColumn("kept", F.lit(True))
    found = links(each, index_of(each, width, threshold, recall), width, threshold)
    sums = found.where("to = -1").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("to <> -1"), "node", "to")
    known = durable(each.select("node", "k1", "k2", "n", "id").join(sums, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "vector-classes")
    least = known.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n_"))
    classes = lookup(known, least.select("component", "component_id"), ["component"], counts=least.select("component", F.col("n_").alias("n")))
    classes = classes.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    keyed = durable(usable(rows, id_col, vec_col).select("id", "k1", "k2"), "vector-keys")
    out = lookup(keyed, classes, ["k1", "k2"], counts=known.select("k1", "k2", "n"))
    return out.select("id", "n_links", "component_id").unionByName(lone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def measured_recall(rows: DataFrame, queries: int = 500, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[float, int]:
    """(recall, links looked at): of the links of ``queries`` vectors of least hash with all vectors, by brute force, the part that
    the index finds."""
    each, width = prepared(rows, id_col, vec_col)
    index = index_of(each, width, threshold, recall)
    who, x = _least(each, queries, width)
    cells, (at, seen) = index.cell(x), index.visits(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, node = _lists(b.column("v"), width), b.column("node").to_numpy()
            i, j = np.nonzero(x @ y.T >= threshold)
            i, j = (k[who[i] != node[j]] for k in (i, j))
            theirs, (row, visited) = index.cell(y), index.visits(y)
            there, back = set(zip(at.tolist(), seen.tolist())), set(zip(row.tolist(), visited.tolist()))
            hit = sum((p, int(theirs[q])) in there or (q, int(cells[p])) in back for p, q in zip(i.tolist(), j.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int64()), pa.array([hit], pa.int64())], ["n", "hit"])

    n, hit = each.select("node", "v").mapInArrow(run, "n long, hit long").agg(F.sum("n"), F.sum("hit")).collect()[0]
    return (hit / n if n else 1.0), n or 0

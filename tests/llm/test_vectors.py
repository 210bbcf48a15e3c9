"""The inverted multi-index against brute force."""

import math
from itertools import islice

import numpy as np
import oracle
import pyarrow as pa
from conftest import SF

from causalnet.llm import queries, vectors
from causalnet.llm.oracles import ORACLES

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, node long, k1 string, n int, cell int, shelf int, component int"


def groups(rng, n, width, sizes, noise=0.12):
    """Random directions, and around some of them groups of near ones."""
    x = rng.normal(size=(n, width))
    parts = [x]
    for s in sizes:
        c = rng.normal(size=width)
        parts.append(c + noise * rng.normal(size=(s, width)))
    out = np.concatenate(parts)
    return out[rng.permutation(len(out))]


def brute(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == label).all():
            return near.sum(1), label
        label = new


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s", 3, "k", 4, 5, 6, 7) for i, v in rows], SCHEMA).repartition(3)


def test_traversal_is_the_multi_sequence():
    rng = np.random.default_rng(1)
    index = vectors.Index((rng.normal(size=(9, 4)), rng.normal(size=(7, 4))), 2.5)
    x = rng.normal(size=(60, 8))
    rows, cells = index.visits(x)
    a, b = index.distances(x)
    for r in range(len(x)):
        whole = list(vectors.multi_sequence(a[r], b[r]))
        assert len(whole) == 63 and [s for s, _, _ in whole] == sorted(s for s, _, _ in whole)
        stop = whole[0][0] + index.slack
        assert cells[rows == r].tolist() == [i * 7 + j for s, i, j in whole if s <= stop]
        assert cells[rows == r][0] == index.cell(x[r : r + 1])[0]
    assert len(list(islice(vectors.multi_sequence(a[0], b[0]), 5))) == 5


def test_shelves_hold_neighbours_and_cut_large_cells():
    first, many = vectors.shelves(np.array([3, 3, 0, 5, 40, 2, 2]), shelf=6, chunk=16)
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 5] and many.tolist() == [1, 1, 1, 1, 3, 1, 1]


def test_recall_of_the_index():
    rng = np.random.default_rng(2)
    x = groups(rng, 3000, 32, [2] * 150 + [400])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.fit(x[:1500], len(x))
    (rows, cells), own = index.visits(x), index.cell(x)
    seen = set(zip(rows.tolist(), cells.tolist()))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert len(i) > 10_000
    assert np.mean([(p, own[q]) in seen or (q, own[p]) in seen for p, q in zip(i, j)]) >= 0.99
    assert len(cells) < 0.2 * len(x) * len(index.books[0]) * len(index.books[1])


def shelf_batches(x, index, shelf, chunk):
    """What the tasks see, without Spark."""
    n = len(x)
    full = np.bincount(index.cell(x), minlength=len(index.books[0]) * len(index.books[1]))
    first, many = vectors.shelves(full, shelf, chunk)
    kind = pa.list_(pa.float64())
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.ones(n, np.int64)), pa.array(x.tolist(), kind)], ["node", "n", "v"])
    sent = pa.Table.from_batches(vectors._sent(index, x.shape[1], full > 0, first, many)(iter([b])))
    return sent.sort_by([("shelf", "ascending"), ("own", "descending")])


def test_counts_whatever_the_shelves():
    rng = np.random.default_rng(3)
    x = groups(rng, 300, 16, [120, 2, 2, 5], 0.1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want, label = brute(x)
    for slack, shelf, chunk, rows in ((9.0, 30, 16, 7), (9.0, 1000, 1000, 5000), (0.3, 50, 20, 64)):
        index = vectors.fit(x, len(x))
        index.slack = slack
        sent = shelf_batches(x, index, shelf, chunk)
        out = pa.Table.from_batches(vectors._compared(16, 0.95)(iter(sent.to_batches(max_chunksize=rows)))).to_pydict()
        got, up = np.zeros(len(x), int), np.arange(len(x))
        for a, b, n in zip(out["node"], out["to"], out["links"]):
            got[a] += n
            if b >= 0:
                up[up == max(up[a], up[b])] = min(up[a], up[b])
        if slack == 9.0:
            assert got.tolist() == want.tolist() and up.tolist() == label.tolist()
        else:
            assert got.sum() >= 0.98 * want.sum() and (got <= want).all()
        assert sum(b >= 0 for b in out["to"]) < 20 * len(x)


def test_whole_operator(spark):
    rng = np.random.default_rng(4)
    x = groups(rng, 400, 12, [60, 2, 2, 2, 9], 0.08)
    want, label = brute(x)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {r["id"]: tuple(r)[1:] for r in vectors.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == len(x) and {i: v[2] for i, v in got.items()} == {i: v[1] == i for i, v in got.items()}
    assert sum(v[0] for v in got.values()) >= 0.98 * want.sum() and all(got[i][0] <= want[i] for i in got)
    assert np.mean([got[i][1] == label[i] for i in got]) >= 0.98
    recall, n = vectors.measured_recall(frame(spark, rows), 300)
    assert n > 1000 and recall >= 0.98


def test_awkward_vectors(spark):
    e = [1.0, 0.0, 0.0]
    near = [0.95, math.sqrt(1 - 0.95**2) * 0.999, 0.0]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0]]
    rows = [(10, e), (11, e), (11, e), (12, [2.0]), (13, [1e300, 0.0, 0.0]), (None, e), (9, near), (20, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, -1.0, 0.0]), (5, [0.0, -1.0, -0.0])]
    rows += [(30 + i, v) for i, v in enumerate(odd)] + [(None, None)]
    got = sorted(map(tuple, vectors.near_duplicates(frame(spark, rows)).collect()), key=repr)
    six = [(i, 6, 9, i == 9) for i in (9, 10, 11, 11, 12, 13, None)]
    lone = [(20, 0, 20, True), (None, 0, None, True), (None, 0, None, True), (None, 1, 5, False), (5, 1, 5, True)] + [(30 + i, 0, 30 + i, True) for i in range(len(odd))]
    assert got == sorted(six + lone, key=repr)
    assert vectors.near_duplicates(frame(spark, [(1, None), (2, [0.0])])).count() == 2
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.measured_recall(frame(spark, [(1, e)])) == (1.0, 0)


def test_query_equals_sql(spark):
    assert oracle.differ(queries.op13_vectors(spark, SF), oracle.connect(SF), ORACLES["op13_vectors"]) == ""

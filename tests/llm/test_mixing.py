"""The mix against a plain simulation of the fair queue."""

import collections
import hashlib
import random

import pytest

from causalnet.llm import mixing, shared

SCHEMA = "doc_id long, text string, source string, finish int, row int, s string"


def shares(sizes, weights, total, cap):
    out, active, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while active:
        whole = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / whole >= cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            active.discard(i)
        left -= sum(out[i] for i in over)
    return out


def simulated(rows, weights=(5, 2, 1), budget=1.5, cap=2, seed=42):
    """[(id, size, source, target, times taken)]; rows that differ in nothing share their takes."""
    size = lambda t: len((t or "").encode().split())
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {n: sum(size(r[1]) for r in rows if r[2] == n) for n in names}
    total = budget * sum(sizes.values())
    target = dict(zip(names, shares([sizes[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], total, cap)))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    turn = lambda r: md5("|".join((str(seed), "" if r[0] is None else str(r[0]), md5(r[1] or ""))))
    queue = []
    for k, n in enumerate(names):
        upto = 0
        for r in sorted((r for r in rows if r[2] == n), key=turn):
            upto += size(r[1])
            if size(r[1]) and target[n]:
                queue += [((upto + e * sizes[n]) / target[n], turn(r), k, e, r) for e in range(cap)]
    used, taken = 0, collections.Counter()
    for q in sorted(queue, key=lambda q: q[:4]):
        used += size(q[4][1])
        if used > total:
            break
        taken[q[4]] += 1
    return taken, target


def rows_of(seed, n):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", " \n", "w " * r.randint(1, 30), "é ß " * r.randint(1, 9), "x" * 3000])
    return [(None if i % 13 == 0 else i, text(), r.choice(["a", "a", "a", "b", "c", None, "d", "E"]), 1, i, "q") for i in range(n)]


@pytest.mark.parametrize("step", [1 << 20, 50])
def test_against_a_simulated_queue(spark, monkeypatch, step):
    monkeypatch.setattr(shared, "RANGE", step)  # many ranges give the same mix
    rows = rows_of(step, 300)
    taken, target = simulated(rows)
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "source", "finish", "row", "s"]
    assert collections.Counter(map(tuple, got.collect())) == +taken
    plan = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(plan) == 300 and all(abs(q["target"] - target[q["source"]]) < 1e-6 for q in plan)
    assert collections.Counter({q["id"]: q["epochs"] for q in plan if q["id"] is not None and q["epochs"]}) == collections.Counter({r[0]: n for r, n in taken.items() if r[0] is not None})


def test_rows_come_in_the_order_of_the_queue(spark):
    got = mixing.queued(spark.createDataFrame(rows_of(5, 200), SCHEMA)).collect()
    assert len(got) > 100 and [q["finish"] for q in got] == sorted(q["finish"] for q in got)


def test_equal_rows_are_taken_each_by_itself(spark):
    d = spark.createDataFrame([(1, "a b", "s")] * 10 + [(2, "c", "s")] * 3, "doc_id long, text string, source string")
    plan = sum(q["epochs"] for q in mixing.mix(d).collect())
    assert mixing.mixed(d).count() == plan and plan >= 17


def test_targets(spark):
    for sizes, weights, total in (([10, 10, 100], (5, 2, 1), 180), ([7, 0, 3, 900, 2, 2], (5, 2, 1), 1371), ([5], (1,), 7.5), ([3, 4], (0.5, 0.25), 10.5)):
        d = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(d, weights, total, 2).collect()}
        want = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total, 2)
        assert all(abs(got[f"s{i}"] - v) < 1e-9 for i, v in enumerate(want))

"""Many sets that share a band but are not alike: results against all pairs, and work that does not grow with their square."""

import random
import time

import numpy as np

from causalnet.llm import substring


def sets_with_common_members(n, common, own, seed=3):
    """Sets that share ``common`` members; of every ten the last two are near copies of each other."""
    r = np.random.default_rng(seed)
    shared = r.integers(0, 1 << 47, common, dtype=np.uint64)
    out = [np.unique(np.concatenate([shared, r.integers(0, 1 << 47, own, dtype=np.uint64)])) for _ in range(n)]
    for k in range(9, n, 10):
        out[k] = np.unique(np.append(out[k - 1][2:], np.uint64(k)))
    return out


def components(edges, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def all_pairs(ids, sets, least):
    s = [set(x.tolist()) for x in sets]
    return components([(ids[i], ids[j]) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= least * len(s[i] | s[j])], ids)


def test_forest_against_all_pairs():
    r = random.Random(17)
    for seed in range(60):
        sets = sets_with_common_members(r.randint(3, 40), r.choice([0, 3, 60]), r.randint(1, 40), seed)
        for _ in range(len(sets) // 2):  # chains: what is alike one is not alike the next but one
            x = sets[r.randrange(len(sets))]
            sets.append(np.unique(np.append(x[r.randint(0, len(x) // 5) :], np.uint64(r.randrange(1 << 40)))))
        ids = list(range(100, 100 + len(sets)))
        for least in (0.5, 0.8, 1.0):
            assert components(substring.similar_forest(np.array(ids), sets, least), ids) == all_pairs(ids, sets, least)


def test_forest_of_many_that_are_not_alike_takes_no_square():
    sets = sets_with_common_members(4000, 30, 120)
    began = time.process_time()
    assert len(substring.similar_forest(np.arange(4000), sets)) == 400
    assert time.process_time() - began < 8


def test_crowded_key_is_cut_to_what_may_be_alike(spark):
    sets = sets_with_common_members(300, 30, 40)
    ids = list(range(300))
    raw = [(i, s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for i, s in zip(ids, sets)]
    table = spark.createDataFrame([(h, bytearray(x)) for h, x in raw], "h long, shingles binary")
    crowd = substring.crowded(spark.createDataFrame([(1, h, 400) for h in ids], "key long, h long, n int"), 50)
    assert crowd.where("w > 1").count() == 300
    assert {r["h"] for r in substring.promising(table, 0.8).collect()} == {k for k in ids if k % 10 > 7}
    found = [(r["a"], r["b"]) for r in substring.verified(crowd, table, 0.8, 50).collect()]
    assert components(found, ids) == all_pairs(ids, sets, 0.8)


def test_sketches_lose_no_pair():
    r = random.Random(23)
    shared = np.random.default_rng(5).integers(0, 1 << 63, 400, dtype=np.uint64)
    for least in (0.5, 0.8, 1.0):
        parts = []
        for _ in range(60):
            x = shared[: r.randint(5, 400)].copy()
            for _ in range(r.randint(0, len(x) // 8)):
                x[r.randrange(len(x))] = r.getrandbits(63)
            parts += [x, np.append(x, x[:3])]
        ends = np.cumsum([len(x) for x in parts])
        rows = substring.sketches(np.concatenate(parts), np.array([(e - len(x), e) for x, e in zip(parts, ends)]))
        sets = [set((x >> np.uint64(16)).tolist()) for x in parts]
        assert rows[:, 0].tolist() == [len(s) for s in sets]
        order = np.argsort(rows[:, 0], kind="stable")
        hit = substring.with_like(np.zeros(len(sets), int), rows[order, 0], (rows[order, 1], rows[order, 2]), least)
        alike = {i for i in range(len(sets)) for j in range(len(sets)) if i != j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
        assert alike <= set(order[hit].tolist())


def test_what_is_like_no_other_of_its_key_is_not_fetched(spark):
    sets = sets_with_common_members(300, 3, 60)
    flat = np.concatenate(sets) << np.uint64(16)
    ends = np.cumsum([len(s) for s in sets])
    rows = substring.sketches(flat, np.array([(e - len(s), e) for s, e in zip(sets, ends)]))
    sketched = spark.createDataFrame([(h, x) for h, x in enumerate(rows.tolist())], "h long, sketch array<long>")
    pairs = spark.createDataFrame([(k, h, 400) for h in range(300) for k in (1, 2 + h // 10)], "key long, h long, n int")
    for most in (50, 2000):
        left = {(r["key"], r["h"]) for r in substring.possible(substring.crowded(pairs, most), sketched, 0.8, most).collect()}
        near = {h for h in range(300) if h % 10 > 7}
        assert near == {h for _, h in left} and {k for k, _ in left} <= {1, *range(2, 32)}

"""The ranked queue on graphs worked by hand, against a full rescan of every step, and at size."""

import math
import time

import numpy as np
import pytest

from causalnet.operators.orientation import collider_score, degenerate_score, induced, logistic, propagate


def scores(triples, i3, **how):
    return [[math.log(p / (1 - p)) if 0 < p < 1 else math.copysign(math.inf, p - 0.5) for p in t] for t in propagate(triples, i3, **how)]


def test_a_collider_and_what_follows():
    # 0 -> 2 <- 1, and 2 - 3: the head at 2 makes the other half of 0 - 2 - 3 a tail at 2.
    got = scores([(0, 2, 1), (0, 2, 3)], [-5.0, 3.0])
    s = collider_score(-5.0)
    assert got[0] == pytest.approx([0.0, s, s, 0.0])
    assert got[1] == pytest.approx([0.0, s, -induced(3.0, s), 0.0])
    # Without latent variables a head at one end is a tail at the other; propagation turns a tail into a head at the far end.
    got = scores([(0, 2, 1), (0, 2, 3)], [-5.0, 3.0], latent=False, propagation=True)
    assert got[0] == pytest.approx([-s, s, s, -s]) and got[1] == pytest.approx([-s, s, -induced(3.0, s), induced(3.0, s)])


def test_the_stronger_of_two_conflicting_colliders_settles():
    # 0 - 1 - 2 and 1 - 2 - 3 are both colliders: they disagree about nothing without latent variables but edge 1 - 2.
    triples, i3 = [(0, 1, 2), (1, 2, 3)], [-4.0, -9.0]
    got = scores(triples, i3, latent=False)
    s = collider_score(-9.0)
    assert got[1] == pytest.approx([-s, s, s, -s])
    # The tail at 1 of 1 - 2 (from 2's head) denies the collider at 1: its unsettled half goes back to one half.
    assert got[0][1] == pytest.approx(0.0) and got[0][2] == pytest.approx(-s) and got[0][3] == pytest.approx(s) and got[0][0] == pytest.approx(0.0)
    half = scores(triples, i3, latent=False, half_v_structure=True)
    assert half[0][1] == pytest.approx(collider_score(-4.0))
    both = scores(triples, i3)  # with latent variables both may be true
    assert both[0][1] > 0 and both[0][2] > 0 and both[1][1] > 0


def test_chains_carry_a_head_on():
    # 0 -> 1 <- 9 settles 1; 0 - 1 - 2 is none, so 1 -> 2; then 1 - 2 - 3 is none: 2 -> 3, each weaker than the last.
    triples, i3 = [(0, 1, 9), (0, 1, 2), (1, 2, 3), (2, 3, 4)], [-20.0, 8.0, 7.0, 6.0]
    got = scores(triples, i3, latent=False, propagation=True)
    first = induced(8.0, collider_score(-20.0))
    second = induced(7.0, first)
    assert got[1][2] == pytest.approx(-first) and got[1][3] == pytest.approx(first)
    assert got[2][1] == pytest.approx(first) and got[2][3] == pytest.approx(second)
    assert got[3][1] == pytest.approx(second) and got[3][3] == pytest.approx(induced(6.0, second))
    still = scores(triples, i3, latent=False)
    assert still[2] == pytest.approx([-first, 0.0, 0.0, 0.0]) and still[3] == [0.0] * 4  # the tail at 1 stays, nothing comes of it


def test_what_is_given_beforehand():
    assert propagate([(0, 1, 2)], [2.0], age={0: 1, 1: 0, 2: 0})[0][1] == 1.0
    p = propagate([(0, 1, 2)], [2.0], age={0: 1, 1: 0, 2: 0}, latent=False)[0]
    assert p[0] == 0.0 and p[1] == 1.0 and p[2] == pytest.approx(logistic(-2.0))
    assert propagate([(0, 1, 2)], [-3.0], contextual=[1])[0][1:3] == (0.0, 0.0)
    assert propagate([(0, 1, 2)], [3.0], consequence=[1], latent=False)[0] == (0.0, 1.0, 1.0, 0.0)
    assert degenerate_score(-2.0) > collider_score(-2.0) and propagate([(0, 1, 2)], [-2.0], degenerate=True)[0][1] == pytest.approx(logistic(degenerate_score(-2.0)))
    assert propagate([], []) == []


def rescanned(triples, i3, latent, spread):
    """Every step looks at all triples: a table of dictionaries keyed by (node, other)."""
    tips = [{(x, z): 0.0, (z, x): 0.0, (z, y): 0.0, (y, z): 0.0} for x, z, y in triples]
    sure = [set() for _ in triples]
    rank = [collider_score(v) if v < 0 else 0.0 for v in i3]
    for (x, z, y), t, r in zip(triples, tips, rank):
        if r > 0:
            t[z, x] = t[z, y] = r
            if not latent:
                t[x, z] = t[y, z] = -r
    left = set(range(len(triples)))
    while left:
        k = min(left, key=lambda j: (-rank[j], j))
        if rank[k] <= 0:
            break
        left.remove(k)
        x, z, y = triples[k]
        edges = []
        for a, b in ((x, y), (y, x)):
            if (z, a) in sure[k]:
                continue
            if tips[k][z, b] < 0 and i3[k] <= 0:
                tips[k][z, a] = 0.0
                if (a, z) not in sure[k]:
                    tips[k][a, z] = 0.0
            else:
                edges.append((a, tips[k][z, a], tips[k][a, z]))
        done = set()
        for a, head, back in edges:
            for j in sorted(left):
                if j in done or (z, a) not in tips[j]:
                    continue
                done.add(j)
                tips[j][z, a] = head
                sure[j].add((z, a))
                if (head > 0 and not latent) or (head < 0 and spread):
                    tips[j][a, z] = back
                    sure[j].add((a, z))
                elif (a, z) not in sure[j] and a != triples[j][1]:
                    tips[j][a, z] = 0.0
                p, q, r = triples[j]
                if {(q, p), (q, r)} <= sure[j]:
                    left.discard(j)
                    continue
                for c, d in ((p, r), (r, p)):
                    w = tips[j][q, c]
                    if (q, c) in sure[j] and w > 0:
                        s = induced(i3[j], w)
                        if i3[j] and s > 0 and abs(tips[j][q, d]) < s:
                            rank[j] = s
                            tips[j][q, d] = -s if i3[j] > 0 else s
                            if (d, q) not in sure[j]:
                                if i3[j] > 0 and spread:
                                    tips[j][d, q] = max(tips[j][d, q], s)
                                if i3[j] < 0 and not latent:
                                    tips[j][d, q] = min(tips[j][d, q], -s)
                        break
    return [tuple(logistic(t[e]) for e in ((x, z), (z, x), (z, y), (y, z))) for (x, z, y), t in zip(triples, tips)]


@pytest.mark.parametrize("seed", range(30))
def test_the_queue_equals_a_rescan(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(4, 14))
    edges = {frozenset(e) for e in ((int(a), int(b)) for a, b in r.integers(0, n, (2 * n, 2))) if len(set(e)) == 2}
    near = {v: {w for e in edges for w in e if v in e and w != v} for v in range(n)}
    triples = [(x, z, y) for z in range(n) for x in sorted(near[z]) for y in sorted(near[z]) if x < y and frozenset((x, y)) not in edges]
    i3 = [float(v) for v in np.where(r.random(len(triples)) < 0.15, 0.0, r.normal(0, 6, len(triples)))]
    for latent in (False, True):
        for spread in (False, True):
            got, want = propagate(triples, i3, latent, spread), rescanned(triples, i3, latent, spread)
            assert len(got) == len(want) and np.allclose(np.array(got).ravel(), np.array(want).ravel(), atol=1e-12)


def test_many_triples_take_seconds():
    r = np.random.default_rng(1)
    n = 60_000
    triples = [(i, i + 1, i + 2) for i in range(n)] + [(int(a), n + 10 + i, int(b)) for i, (a, b) in enumerate(r.integers(0, n, (40_000, 2))) if a != b]
    i3 = r.normal(0, 5, len(triples)).tolist()
    start = time.time()
    got = propagate(triples, i3, latent=False, propagation=True)
    assert len(got) > 99_000 and time.time() - start < 20

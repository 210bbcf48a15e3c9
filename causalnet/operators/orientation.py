"""Tip probabilities of unshielded triples, by propagation in the order of a ranked queue (driver; one entry per triple).

Tips carry scores, the log odds of a head. A triple x - z - y of negative three-point information (a collider) starts with a
head at z from both sides; its rank is that score. The triple of highest rank settles its edges: their scores go to all triples
still in the queue that share the edge, where a settled head at the middle may say something about the other half; if it
does, the triple's rank becomes what it says. A triple both of whose middle tips are settled leaves the queue. Two heads meet at the
middle of a collider only: a tail on its other half takes the head back.

Only ranks that change enter the heap again, and an index of edges leads to the triples that share one, so the
work follows the number of triples and of the pairs of them that share an edge.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

SURE = 1.7e308  # of a tip that is given beforehand
#: Tips of x - z - y: at x, at z from x, at z from y, at y.
X, ZX, ZY, Y = range(4)
OUTER = {ZX: X, ZY: Y}


def logistic(s: float) -> float:
    if s > 700:
        return 1.0
    return 0.0 if s < -700 else 1 / (1 + math.exp(-s))


def collider_score(i3: float) -> float:
    """Log odds of a head, for negative i3."""
    return -i3 - math.log(2) + math.log1p(math.exp(i3))


def degenerate_score(i3: float) -> float:
    """The same where all orientations of a triple that is no collider count as one."""
    return -i3 + math.log(3 - 2 * math.exp(i3))


def induced(i3: float, w: float) -> float:
    low, high = min(abs(i3), w), max(abs(i3), w)
    return low - math.log1p(math.exp(low - high) + (math.exp(-high) if high < 700 else 0.0))


class Propagation:
    def __init__(self, triples: Sequence[tuple[int, int, int]], i3: Sequence[float], latent: bool, propagation: bool, half_v_structure: bool):
        self.triples, self.i3 = list(triples), list(i3)
        self.latent, self.spread, self.half = latent, propagation, half_v_structure
        self.score = [[0.0] * 4 for _ in self.triples]
        self.settled = [[False] * 4 for _ in self.triples]
        self.rank = [0.0] * len(self.triples)
        self.queue: list[tuple[float, int]] = []

    def fix(self, k: int, tip: int, score: float) -> None:
        self.score[k][tip], self.settled[k][tip] = score, True

    def collide(self, k: int, degenerate: bool) -> None:
        s = (degenerate_score if degenerate else collider_score)(self.i3[k])
        self.rank[k] = s
        self.score[k][ZX] = self.score[k][ZY] = s
        if not self.latent:
            self.score[k][X] = self.score[k][Y] = -s

    def induce(self, k: int) -> bool:
        """What a settled head at the middle says about the other half; whether it is more than was known."""
        s, settled, i3 = self.score[k], self.settled[k], self.i3[k]
        head = next((t for t in (ZX, ZY) if settled[t] and s[t] > 0), None)
        if head is None or i3 == 0:
            return False
        mid = ZY if head == ZX else ZX
        end = OUTER[mid]
        said = induced(i3, s[head])
        if said <= 0 or abs(s[mid]) >= said:
            return False
        self.rank[k] = said
        if i3 > 0:  # no collider: a tail here
            s[mid] = -said
            if self.spread and not settled[end]:
                s[end] = max(s[end], said)
        else:
            s[mid] = said
            if not self.latent and not settled[end]:
                s[end] = min(s[end], -said)
        return True

    def receive(self, k: int, w: int, z: int, at_z: float, at_w: float) -> None:
        """Scores of the settled edge w - z, which the triple shares: ``at_z`` at z is settled here as well; ``at_w`` follows
        from a head where there are no latent variables, and from a tail where orientations propagate."""
        x, mid, y = self.triples[k]
        first = {w, z} == {x, mid}
        tips = (X, ZX) if first else (Y, ZY)
        near, far = (tips[1], tips[0]) if z == mid else tips
        self.fix(k, near, at_z)
        if (at_z > 0 and not self.latent) or (at_z < 0 and self.spread):
            self.fix(k, far, at_w)
        elif not self.settled[k][far] and far in (X, Y):
            self.score[k][far] = 0.0

    def push(self, k: int) -> None:
        heapq.heappush(self.queue, (-self.rank[k], k))

    def run(self) -> None:
        shared: dict[frozenset, list[int]] = {}
        for k, (x, z, y) in enumerate(self.triples):
            for e in (frozenset((x, z)), frozenset((z, y))):
                shared.setdefault(e, []).append(k)
            self.push(k)
        waiting = [True] * len(self.triples)
        while self.queue:
            rank, k = heapq.heappop(self.queue)
            if not waiting[k] or -rank != self.rank[k]:
                continue
            if self.rank[k] <= 0:
                break
            waiting[k] = False
            x, z, y = self.triples[k]
            s, settled = self.score[k], self.settled[k]
            final: list[tuple[int, int, int]] = []  # (w, tip at z, tip at w)
            for w, mid, other in ((x, ZX, ZY), (y, ZY, ZX)):
                if settled[mid]:
                    continue
                if s[other] < 0 and self.i3[k] <= 0 and not self.half:
                    s[mid] = 0.0
                    if not settled[OUTER[mid]]:
                        s[OUTER[mid]] = 0.0
                else:
                    final.append((w, mid, OUTER[mid]))
            told: set[int] = set()
            for w, at_z, at_w in final:
                for j in shared[frozenset((w, z))]:
                    if not waiting[j] or j in told:
                        continue
                    told.add(j)
                    self.receive(j, w, z, s[at_z], s[at_w])
                    if self.settled[j][ZX] and self.settled[j][ZY]:
                        waiting[j] = False
                    elif self.induce(j):
                        self.push(j)


def propagate(triples: Sequence[tuple[int, int, int]], i3: Sequence[float], latent: bool = True, propagation: bool = False, contextual: Sequence[int] = (), consequence: Sequence[int] = (), age: dict[int, int] | None = None, degenerate: bool = False, half_v_structure: bool = False) -> list[tuple[float, float, float, float]]:
    """Head probabilities (at x, at z of x-z, at z of z-y, at y) for triples (x, z, y).

    ``age`` gives a node's lag where time is known: the newer node of an edge gets a head."""
    p = Propagation(triples, i3, latent, propagation, half_v_structure)
    causes, effects = set(contextual), set(consequence)
    for k, (x, z, y) in enumerate(p.triples):
        if p.i3[k] < 0:
            p.collide(k, degenerate)
        for w, outer, mid in ((x, X, ZX), (y, Y, ZY)):
            if age and w in age and z in age and age[w] != age[z]:
                new, old = (outer, mid) if age[w] < age[z] else (mid, outer)
                p.fix(k, new, SURE)
                if not latent:
                    p.fix(k, old, -SURE)
        for node, tips in ((x, (X,)), (z, (ZX, ZY)), (y, (Y,))):
            if node in causes:
                for t in tips:
                    p.fix(k, t, -SURE)
        opposite = {X: ZX, Y: ZY, ZX: X, ZY: Y}
        for node, tips in ((x, (X,)), (y, (Y,)), (z, (ZX, ZY))):
            if node in effects:
                for t in tips:
                    p.fix(k, t, SURE)
                    if not latent:
                        p.fix(k, opposite[t], -SURE)
        p.induce(k)
    p.run()
    return [tuple(logistic(v) for v in s) for s in p.score]

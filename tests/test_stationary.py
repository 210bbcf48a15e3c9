import numpy as np
import pandas as pd

from causalnet.operators.network import Edge, Reconstruction
from causalnet.plans.requests import Engine
from causalnet.sources.observations import Options, Variable


class Answers:
    """An engine that knows given answers only."""

    two, three, tie = staticmethod(Engine.two), staticmethod(Engine.three), staticmethod(Engine.tie)

    def __init__(self, variables, known):
        self.variables, self.known, self.asked = variables, known, []

    def get(self, request):
        return self.known.get(request)

    def run(self, requests):
        for q in requests:
            self.asked.append(q)
            self.known.setdefault(q, {"n": 9.0, "i3": -5.0 if q[:4] == ("3", 0, 3, 2) else 0.0, "k3": 0.0, "i2": 0.0, "k2": 0.0, "score": 0.0})


def test_ties_go_to_what_shares_most():
    names = [Variable(c) for c in "abcde"]
    score = {"n": 9.0, "i3": 2.0, "k3": 0.0, "i2": 4.0, "k2": 0.0, "score": 1.5}
    known = {Engine.three(0, 1, z): dict(score) for z in (2, 3)} | {Engine.three(0, 1, 4): score | {"score": 1.0}}
    known |= {Engine.tie(0, 1, 2): {"shared": 3.0}, Engine.tie(0, 1, 3): {"shared": 8.0}}
    r, e = Reconstruction(Answers(names, known), Options(latent="yes")), Edge(0, 1)
    r.wanted = []
    r._best(e, [], {}, None)
    assert (e.top, e.share) == (3, 0.5)
    known[Engine.tie(0, 1, 2)] = {"shared": 8.0}
    r._best(e, [], {}, None)
    assert e.top == 2


def test_tie_value_is_information_with_both_ends(spark):
    g = np.random.default_rng(0)
    p = pd.DataFrame({c: g.integers(0, 3, 400).astype(str) for c in "xyz"})
    p.loc[:40, "y"] = None
    p["z"] = np.where(g.random(400) < 0.6, p["x"], p["z"])
    e = Engine(spark.createDataFrame(p), [Variable(c) for c in "xyz"], Options(cplx="bic"))
    e.run([e.tie(0, 1, 2)])
    known = p.dropna()
    codes = [known[c].astype("category").cat.codes.to_numpy() for c in "xyz"]
    want = 0.0
    for k in (0, 1):
        n = pd.crosstab(codes[k], codes[2]).to_numpy()
        t = n.sum()
        want += (n * np.log(n * t / np.outer(n.sum(1), n.sum(0)))).sum() - 0.5 * np.log(t) * 4
    assert abs(e.get(e.tie(0, 1, 2))["shared"] - want) < 1e-6
    e.close()


def lagged(*names, contextual=()):
    return [Variable(n, contextual=n in contextual) for n in names]


def test_earlier_times_and_own_past():
    v = lagged("a_lag0", "b_lag0", "k_lag0", "a_lag2", "b_lag2", "a_lag4", contextual=["k_lag0"])
    r = Reconstruction(Answers(v, {}), Options(mode="TS", latent="yes"))
    assert r.repeats(0, 1) == [(3, 4)] and r.repeats(3, 1) == [(5, 4)] and r.repeats(0, 2) == [(3, 2), (5, 2)]
    assert 3 not in r._candidates(0, 2, [], {}, None) and 4 in r._candidates(0, 2, [], {}, None)
    assert Reconstruction(Answers(v, {}), Options(latent="yes")).repeats(0, 1) == []


def test_the_strongest_probability_of_all_times_counts():
    # a0 - b0 and a0 - a2 are edges; b2 - a2 stands for a0 - b0 two steps before and makes b2 - a2 - a0 a triple.
    v = lagged("a_lag0", "b_lag0", "a_lag2", "b_lag2")
    edges = {(0, 1): Edge(0, 1), (0, 2): Edge(0, 2)}
    for latent, seen in (("orientation", True), ("no", False)):
        r = Reconstruction(Answers(v, {}), Options(mode="TS", latent=latent), age={0: 0, 1: 0, 2: 2, 3: 2})
        r.edges = {p: Edge(*p) for p in edges}
        r.orient()
        triples = {(t["x"], t["z"], t["y"]) for t in r.triples}
        assert (1, 0, 2) in triples and ((0, 2, 3) in triples) == seen
        assert r.edges[0, 1].p[0] > 0.9 if seen else r.edges[0, 1].p[0] == 0.5  # i3 < 0 makes a2 a collider of b2 and a0
        assert r.edges[0, 2].p[0] == 1.0  # the newer end has a head

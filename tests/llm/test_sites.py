"""Posteriors of hosts and paths against plain sums, and SimHash fingerprints bit by bit."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from causalnet.llm import quality, simhash


def plain(rows, weight=0.25, keep=0.5):
    """(host posterior, path posterior, posterior, kept) of each (id, host, path, label, evidence), itself left out of its sites."""
    own = [r[4] if r[3] is None else r[3] for r in rows]
    hosts, paths = {}, {}
    for r, e in zip(rows, own):
        hosts.setdefault(r[1], []).append(e)
        paths.setdefault((r[1], r[2]), []).append(e)
    mean = min(max(sum(own) / len(own), 1e-3), 1 - 1e-3)

    def prior(sites):
        means, n = [np.mean(s) for s in sites.values()], [len(s) for s in sites.values()]
        spread = max(np.var(means) - mean * (1 - mean) * np.mean([1 / k for k in n]), 1e-4)
        return min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4)

    kh, kp = prior(hosts), prior(paths)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for r, e in zip(rows, own):
        h, p = hosts[r[1]], paths[r[1], r[2]]
        host = (kh * mean + sum(h) - e) / (kh + len(h) - 1)
        path = (kp * host + sum(p) - e) / (kp + len(p) - 1)
        z = logit(r[4]) + weight * (logit(path) - math.log(mean / (1 - mean)))
        out.append((host, path, 1 / (1 + math.exp(-z))))
    return out


SCHEMA = "id long, th long, host string, path string, y double, evidence double"


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_against_plain_sums(spark, seed):
    r = random.Random(seed)
    hosts = ["big"] * 60 + ["a", "b", "c", None, ""] * 4
    base = {"big": 0.8, "a": 0.2, "b": 0.9, "c": 0.5, None: 0.3, "": 0.6}
    rows = []
    for i in range(1500):
        h = r.choice(hosts)
        rows.append((i, h, r.choice(["en", "de", None, ""]), r.choice([None, None, 0.0, 1.0]), min(max(r.gauss(base[h], 0.2), 0.0), 1.0)))
    rows += [(2000, "only", "here", None, 0.7), (2001, "only one label", None, 1.0, 0.1), (None, "a", "en", None, 0.4), (7, *rows[7][1:])]
    df = spark.createDataFrame([(i, k, h, p, y, e) for k, (i, h, p, y, e) in enumerate(rows)], SCHEMA).repartition(3)
    got = {q["th"]: q for q in quality.site_posteriors(df).collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    for k, (host, path, posterior) in enumerate(want):
        q = got[k]
        assert (q["host_posterior"], q["path_posterior"], q["posterior"]) == pytest.approx((host, path, posterior), rel=1e-9), rows[k]
        assert q["kept"] == (q["posterior"] >= 0.5)
    own = [e if y is None else y for _, _, _, y, e in rows]
    lone = got[1500]  # the only document of its site has its prior
    assert lone["host_posterior"] == pytest.approx(sum(own) / len(own)) == pytest.approx(lone["path_posterior"])


def test_a_posterior_equal_to_the_limit_is_kept(spark):
    df = spark.createDataFrame([(i, i, "h", "p", None, 0.5) for i in range(6)], SCHEMA)
    got = quality.site_posteriors(df).collect()
    assert {q["posterior"] for q in got} == {0.5} and all(q["kept"] for q in got)
    assert not any(q["kept"] for q in quality.site_posteriors(df, keep=0.5000001).collect())
    assert quality.site_posteriors(df.where("id < 0")).count() == 0


def bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_bit_by_bit():
    r = random.Random(3)
    words = ["Alpha", "beta", "É", "日本", "x\xa0y", "#", "GAMMA", "a\x1cb", "ß"]
    texts = [None, "", " \n\t", "one", "One TWO three", "a b c d", "a a a a a a"] + ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\x0b"]) for _ in range(r.randint(1, 60))) for _ in range(300)]
    assert [simhash.fingerprint(t) for t in texts] == [bits(t) for t in texts]

"""Pieces against the tokenizer itself, the choice of sequences against a plain loop, and how near the bound it comes."""

import collections
import struct
import zlib

import numpy as np
import pytest

from causalnet.llm import packing, queries


def test_pieces_against_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [(1, None, 5), (2, "", 6), (3, "One two, three! " * 400, 7), (None, "é ß", 8), (4, "same", 9), (4, "same", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in packing.token_pieces(d, path, size=100).collect())
    t, want = Tokenizer.from_file(path), collections.Counter()
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 100)):
            part = ids[at : at + 100]
            want[(i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), struct.pack(f"<{len(part)}H", *part))] += 1
    assert got == want


def plain(lengths, size, max_docs, max_cost, weights, rule):
    """Best fit, one piece and one sequence at a time."""
    cap, place = (size, max_docs, max_cost), {}
    seqs = [[1.0, 1.0, 1.0] for _ in range(packing.lower_bound(np.array(lengths), size, max_docs, max_cost) if rule == "dot" else 0)]
    need = lambda n: (n / cap[0], 1 / cap[1], n * n / cap[2])
    for p in sorted(range(len(lengths)), key=lambda p: (-round(max(need(lengths[p])), 12), -lengths[p])):
        best = None
        for k, room in enumerate(seqs):
            rest = [a - b for a, b in zip(room, need(lengths[p]))]
            if min(rest) > -1e-9:
                v = sum(w * a * b for w, a, b in zip(weights, need(lengths[p]), room)) if rule == "dot" else -sum(w * r * r for w, r in zip(weights, rest))
                if best is None or v > best[0] + 1e-9:
                    best = (v, k)
        if best is None:
            seqs.append([1.0, 1.0, 1.0])
            best = (0, len(seqs) - 1)
        place[p] = best[1]
        seqs[best[1]] = [a - b for a, b in zip(seqs[best[1]], need(lengths[p]))]
    return [place[p] for p in range(len(lengths))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_choice_against_a_plain_loop(rule):
    r = np.random.default_rng(4)
    for trial in range(8):
        n = r.integers(1, 60, 120)
        args = (100, int(r.integers(4, 12)), float(r.integers(3600, 9000)), (1.0, 0.7, 0.4), rule)
        b, o = packing.best_fit(n, *args)
        assert b.tolist() == plain(n.tolist(), *args)
        for k in range(b.max() + 1):
            own = b == k
            assert n[own].sum() <= 100 and own.sum() <= args[1] and (n[own] ** 2).sum() <= args[2]
            at = np.argsort(o[own])
            assert (o[own][at] == np.cumsum(n[own][at]) - n[own][at]).all()


def test_near_the_lower_bound_when_every_capacity_binds():
    r = np.random.default_rng(5)
    n = np.minimum(2048, np.ceil(r.lognormal(5.2, 1.2, 20_000))).astype(int)
    used = {}
    for max_docs, max_cost, rule in ((4096, 4096.0**2, "norm"), (4096, 4096.0**2, "dot"), (8, 4096.0**2, "dot"), (64, 1.5 * 2048**2, "dot"), (12, 1.5 * 2048**2, "dot")):
        b, _ = packing.best_fit(n, 4096, max_docs, max_cost, (1.0, 1.0, 1.0), rule)
        used[max_docs, max_cost, rule] = len(set(b)) / packing.lower_bound(n, 4096, max_docs, max_cost)
    assert all(v < 1.05 for v in used.values()), used
    loose = packing.best_fit(n, 4096, 4096, 4096.0**2, (1.0, 0.01, 0.01), "norm")[0]
    sizes = [((loose == k).sum(), (n[loose == k] ** 2).sum()) for k in range(loose.max() + 1)]
    assert any(d > 12 for d, _ in sizes) and any(c > 1.5 * 2048**2 for _, c in sizes)  # the capacities above did bind

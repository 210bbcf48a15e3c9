"""Passages against a comparison of all pairs, recall by length, and awkward rows."""

import os
import random

import pytest

from causalnet.llm import shared, substring


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_against_all_pairs(spark):
    """Every run of 50 equal words and every near copy of a line is found; nothing else is."""
    r = random.Random(21)
    vocab = [f"v{i}" for i in range(3000)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [words(r.choice([30, 50, 55, 80, 120])) for _ in range(40)]
    lines = [words(r.choice([25, 40, 90])) for _ in range(30)]
    texts = []
    for i in range(240):
        parts = [words(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            p = list(r.choice(shared))
            if r.random() < 0.3:
                p[r.randrange(len(p))] += "é" if r.random() < 0.5 else "x"
            parts += [[w.upper() for w in p] if r.random() < 0.3 else p, words(r.randint(1, 40))]
        body = [[w for p in parts for w in p]]
        if r.random() < 0.4:
            line = list(r.choice(lines))
            for _ in range(r.choice([0, 1, 2, 6])):
                line[r.randrange(len(line))] = r.choice(vocab)
            body.append(line)
        texts.append("\n".join(" ".join(b) for b in body if b))
    fold = lambda t: t.encode().lower().split()
    must, may = set(), set()
    runs = [{tuple(w[k : k + 50]) for k in range(len(w) - 49)} for w in map(fold, texts)]
    short = [{tuple(w[k : k + 30]) for k in range(len(w) - 29)} for w in map(fold, texts)]
    paras = [[shingles(fold(x)) for x in t.split("\n") if len(x.split()) >= 20] for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            near = any(len(a & b) >= 0.8 * len(a | b) for a in paras[i] for b in paras[j])
            if runs[i] & runs[j] or near:
                must |= {i, j}
            if short[i] & short[j] or near:
                may |= {i, j}
    got = {q["doc_id"] for q in substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(must) > 100 and len(may) < 230 and must <= got <= may


@pytest.mark.parametrize(("length", "least"), [(40, 0.4), (45, 0.6), (50, 1.0), (100, 1.0)])
def test_recall_by_length_in_the_middle_of_sentences(spark, length, least):
    r = random.Random(length)
    vocab = [f"k{i}" for i in range(4000)]
    words = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = []
    for k in range(60):
        p = words(length)
        rows += [(2 * k, f"{words(30)} é {p} {words(35)}"), (2 * k + 1, f"{words(25)} {p.upper()} {words(50)}")]
    got = {q["doc_id"] for q in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()}
    print("recall", length, len(got) / 60)
    assert all(i % 2 for i in got) and len(got) >= least * 60


def test_awkward_rows(spark):
    r = random.Random(5)
    words = lambda n: " ".join("w" + str(r.randrange(5000)) for _ in range(n))
    p = words(60)
    long = f"{words(20000)} {p} {words(20000)}"
    least = -(1 << 63)
    schema = "doc_id long, text string, h long, kept long, place int, start string, th double"
    rows = [(None, f"{words(9)} {p}"), (None, f"{words(9)} {p}"), (1, long), (1, long), (2, p), (2, p + " tail"), (3, None), (4, ""), (least, p), (5, words(10)), (6, "x" * 100_000)]
    d = spark.createDataFrame([(*x, 1, 2, 3, "s", 0.5) for x in rows], schema)
    got = substring.repeated_passages(d)
    spans = got.collect()
    assert {q["doc_id"] for q in spans} == {None, 1, 2, least} and {q["kept_id"] for q in spans} == {None}
    assert {q["doc_id"] for q in spans if q["removed"]} == {1, 2, least}
    cut = substring.without_repeats(d, got)
    assert cut.columns == d.columns
    left = sorted(((x["doc_id"], x["text"]) for x in cut.collect()), key=repr)
    # With one word more the line is still a near copy, so it goes whole.
    want = [(i, t if t is None or i is None else "" if t == p + " tail" else t.replace(p, "")) for i, t in rows]
    assert left == sorted(want, key=repr)


def test_windows_go_once_their_repeats_are_found(spark):
    r = random.Random(6)
    words = lambda n: " ".join("w" + str(r.randrange(5000)) for _ in range(n))
    p = words(60)
    before = list(shared.made)
    got = substring.repeated_passages(spark.createDataFrame([(1, f"{words(30)} {p}"), (2, f"{words(40)} {p} {words(30)}")], "doc_id long, text string"))
    (units,) = [u.partition("://")[2] for u in shared.made if u not in before and "/paragraphs-" in u]
    assert [x for x in os.listdir(units) if x.startswith("kind=")] == ["kind=0"]
    assert {q["doc_id"]: q["removed"] for q in got.collect()} == {1: False, 2: True}
    assert substring.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0

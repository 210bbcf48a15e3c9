"""Decoding and its weights against plain formulas; learning of a rare language; ties and clashing columns."""

import math
import random
import zlib

import numpy as np

from causalnet.llm import langid


def test_decoding_against_a_plain_formula():
    r = np.random.default_rng(1)
    code = langid.codewords(4)
    model = langid.Codes(["a", "b", "c", "d"], code, r.normal(size=(6, code.shape[1])), r.normal(size=code.shape[1]), np.abs(r.normal(size=code.shape[1])))
    x = r.normal(size=(50, 6))
    best, score, gap = model.predict(x)
    for k in range(50):
        m = [sum(x[k, i] * model.weights[i, j] for i in range(6)) + model.bias[j] for j in range(code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-v * c)) for t, v, c in zip(model.trust, m, row)) for row in code]
        p = sorted((math.exp(-v) / sum(math.exp(-u) for u in loss) for v in loss), reverse=True)
        assert best[k] == loss.index(min(loss)) and abs(score[k] - p[0]) < 1e-9 and abs(gap[k] - (p[0] - p[1])) < 1e-9


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(5)
    distance = min(int((code[a] != code[b]).sum()) for a in range(5) for b in range(a))
    assert distance >= 8
    for k in range(5):
        m = 4 * code[k]
        m[:3] *= -1  # three bits wrong
        model = langid.Codes(list("abcde"), code, np.zeros((1, code.shape[1])), m, np.ones(code.shape[1]))
        assert model.predict(np.zeros((1, 1)))[0][0] == k


def test_trust_follows_the_rows_not_learned_from():
    assert np.allclose(langid.trust(np.array([[1, 1, 0], [1, 0, 1], [1, 1, 0], [1, 1, 1]], bool)), np.array([0.5, 0.25, 1e-3]) / np.mean([0.5, 0.25, 1e-3]))


def test_a_rare_language_is_learned(spark):
    r = random.Random(2)
    text = lambda abc: " ".join("".join(r.choice(abc) for _ in range(r.randint(2, 7))) for _ in range(40))
    abcs = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstuv"}
    rows = [(i, text(abcs[v]), v, "x", 0.5, 1) for i, v in enumerate(["aa"] * 3000 + ["bb"] * 400 + ["cc"] * 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, score double, k int")
    got = {q["id"]: q for q in langid.identify(d, learn=60).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == len(rows) and sum(got[i]["held_out"] for i in got) == len(held)
    rare = [i for i in held if rows[i][2] == "cc"]
    assert rare and all(got[i]["lang_pred"] == "cc" for i in rare)
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) / len(held) > 0.99


def test_a_text_between_two_languages_is_flagged(spark):
    r = random.Random(3)
    text = lambda abc, n: " ".join("".join(r.choice(abc) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcde" if i % 2 else "vwxyz", 60), "u" if i % 2 else "v") for i in range(400)]
    rows += [(1000, " ".join(text(a, 1) for _ in range(60) for a in ("abcde", "vwxyz")), None), (1001, "!? 12", None), (1002, None, None), (1002, None, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {q["id"]: q for q in got}
    assert len(got) == 404 and by[1000]["ambiguous"] and not by[1]["ambiguous"]
    assert by[1001]["lang_pred"] == by[1002]["lang_pred"] == "und" and by[1001]["score"] == 0

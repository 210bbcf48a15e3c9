"""The trees on sentences of another hand, thresholds, and rewriting against plain slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalnet.llm import pii

PRIVATE = [
    "Please use the password: hunter2hunter2hunter2XZ9 for the portal.", "export GITHUB_TOKEN=ghp_R4nd0mAbCdEfGhIjKlMnOpQrStUvWxYz01", 'api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "AWS secret: wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY",
    "You can phone me on 415-555-0132 after six", "her number is (212) 555-0187 and she answers", "mobile 202.555.0143 or mail", "ssn 078-05-1120 on the form", "his social security 219-09-9999 leaked", "IBAN DE89370400440532013000 for the rent", "transfer it to GB29 3040 0440 5320 1300 00 today", "passport 123456789 was stolen",
]
HARMLESS = [
    "commit 4b825dc642cb6eb9a060e54bf8d69288fbee4904 broke it", "sha256 e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855 of the image", "order 123456789 was shipped", "isbn 9783161484100 is out of print", "in 2019-05-17 we met", "version 10.0.19041.1288.1 of it", "==================== title", "the antidisestablishmentarianism movement", "well-known-long-slug-of-words-12", "part 84736251 does not fit", "ticket 20231207 is closed", "total 1000000000 units",
]


def test_spans_that_no_template_made(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE + HARMLESS)], "doc_id int, text string")
    hit = {r["doc_id"]: len(r["spans"]) > 0 for r in pii.find(d).collect()}
    caught = sum(hit[i] for i in range(len(PRIVATE)))
    wrong = sum(hit[len(PRIVATE) + i] for i in range(len(HARMLESS)))
    assert caught >= 11 and wrong <= 1, [t for i, t in enumerate(PRIVATE + HARMLESS) if hit[i] != (i < len(PRIVATE))]


def test_thresholds():
    p, y = np.array([0.55, 0.6, 0.9, 0.95]), np.array([0, 1, 1, 1])
    assert 0.55 < pii.threshold_for(p, y, 0.99) <= 0.56
    with pytest.raises(ValueError):
        pii.threshold_for(p, np.array([0, 0, 1, 0]), 0.99)


def test_rewriting_against_slices(spark):
    r = random.Random(9)
    bits = ["a@b.co", "1.2.3.4", "x y", "é𝒳ß", "+49 30 1234567", "token = 'ab12cd34ef56ab78cd90ef12'", "word " * 300, "\n", "4111 1111 1111 1111", "415-555-0132"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "q" * 9000 + " a@b.co", "a@b.co" * 3 + " " + "z" * 8191 + " 1.2.3.4"]
    d = spark.createDataFrame([(i if i % 7 else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id int, text string, spans string, kind int")
    found = pii.find(d, out_col="found").withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    red = pii.redacted(d)
    assert red.columns == ["doc_id", "text", "spans", "kind"]
    want = []
    for q in found:
        t, at, out = q["text"], 0, ""
        for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in q["found"]):
            if start >= at:
                out += t[at:start] + f"[{pii.NAMES[kind].upper()}]"
            at = max(at, end)
        want.append((q["doc_id"], None if t is None else out + t[at:], "x", 3))
    assert sorted(map(tuple, red.collect()), key=repr) == sorted(want, key=repr)

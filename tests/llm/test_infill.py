"""Rank and select against plain counts, the transformation against its definition and its SQL."""

import hashlib
import random
import re

import numpy as np
import oracle
import pyarrow as pa
import pytest
from conftest import SF

from causalnet.llm import infill, queries
from causalnet.llm.oracles import ORACLES

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "bc", " ", "  ", "\n", "\t\r", "\x0b", "é", "日本", "\xa0", "𝒳", "<P", "S>", "<", "\x1c", "."]


@pytest.mark.parametrize("n, share", [(1, 1.0), (511, 0.5), (512, 0.1), (513, 0.9), (5000, 0.02), (5000, 0.0), (2048, 1.0)])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    b, at = infill.Bits(bits), np.flatnonzero(bits)
    assert b.ones == len(at)
    assert b.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
    assert b.select(np.arange(len(at))).tolist() == at.tolist()


def test_token_ends_of_many_texts():
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(800)]
    data, offsets = infill.texts(pa.array(["x", *texts]).slice(1))
    base, ends = int(offsets[0]), offsets[1:] - offsets[0]
    bits = infill.Bits(infill.token_ends(data[base : int(offsets[-1])], ends, np.diff(offsets) > 0))
    assert (bits.rank(ends) - bits.rank(offsets[:-1] - base)).tolist() == [len(TOKEN.findall(t)) for t in texts]
    for size in (1, 50, 1 << 20):
        runs = list(infill.slices(offsets, size))
        assert [a for a, _ in runs][1:] == [b for _, b in runs][:-1] and runs[0][0] == 0 and runs[-1][1] == len(texts)


def plain(i, text, seed=42, rate=50, spm=80):
    """The definition, word by word."""
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = TOKEN.findall(t)
    n = len(tokens)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = "".join(tokens[:p]), "".join(tokens[p:q]), "".join(tokens[q:])
    if not t or any(k in t for k in infill.MARKS) or h3 % 100 >= rate:
        return i, n, "plain", None, None, t
    if h4 % 100 < spm:
        return i, n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return i, n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


SCHEMA = "doc_id long, text string, id long, n int, form string, h1 long, output string"


def test_transform_equals_definition(spark):
    r = random.Random(5)
    texts = [None, "", " ", "\n \t", "a", " a", "a ", "x<P>y", "<S>", "<M> b", "<<P>", "x" * 20_000, "w " * 30_000, "é " * 500]
    texts += ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, None), (3, "\n \t"), (3, "\n \t")]
    df = spark.createDataFrame([(*x, 1, 2, "f", 3, "o") for x in rows], SCHEMA).repartition(3)
    got = infill.transform(df)
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain(*x) for x in rows), key=key)
    back = got.select("id", infill.restored(got["output"], got["form"]).alias("t")).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, back), key=order) == sorted(((i, t or "") for i, t in rows), key=order)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}


def test_other_marks_and_rates(spark):
    rows = [(i, f"one two three {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = ("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")
    got = infill.transform(df, seed=7, rate=100, spm=0, marks=marks)
    assert {r["form"] for r in got.collect()} == {"psm"}
    assert sorted(got.select(infill.restored(got["output"], got["form"], marks)).collect()) == sorted((t,) for _, t in rows)
    assert {r["form"] for r in infill.transform(df, rate=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("abc", "b", "x"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            infill.transform(df, marks=bad)


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    known = lambda c: f"coalesce({c}, -1) AS {c}"
    got = queries.op12_fill_in_middle(spark, SF).na.fill(-1)
    sql = f"SELECT doc_id, n, form, {known('prefix_chars')}, {known('middle_chars')}, output_sha256, restored_sha256 FROM ({ORACLES['op12_fill_in_middle']})"
    assert oracle.differ(got, oracle.connect(SF), sql) == ""

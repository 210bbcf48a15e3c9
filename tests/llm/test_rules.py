"""The rules' references and distances against numpy, and their query and the mix's against DuckDB SQL."""

import collections
import math
import random
import re

import numpy as np
import oracle
import pytest
from conftest import SF

from causalnet.llm import queries, rules, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    assert oracle.differ(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name]) == ""


def classes(t):
    left, out = t, []
    for p in (r"[a-z]", r"[ \t\n\x0B\f\r]", r"[^\x00-\x7F]", r"[A-Z]", r"[.,;:!?'\"()\-]", r"[0-9]"):
        less = re.sub(p, "", left)
        out.append(len(left) - len(less))
        left = less
    return [*out, len(left)]


def distance(p, q):
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def share(c):
    c = np.array(c, float)
    return c / c.sum() if c.sum() else c


def test_against_numpy(spark):
    r = random.Random(6)
    common = {"aa": ["go", "ta", "Ki", "wo"], "bb": ["ße", "él", "un"], "日本": ["の", "は"]}

    def text(v, n):
        own = common.get(v, ["zz"])
        return " ".join(r.choice(own) if r.random() < 0.4 else "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9))) for _ in range(n))

    langs = ["aa"] * 60 + ["bb"] * 45 + ["日本"] * 30 + ["cc"] * 8 + [None] * 15
    rows = [(None if i == 3 else i, text(v, r.choice([60, 80, 200])), v, 1, "x") for i, v in enumerate(langs)]
    rows += [(900, None, "aa", 1, "x"), (901, "#$%" * 4000, "aa", 1, "x"), (902, " ".join(f"{i}{i}" for i in range(90)), "bb", 1, "x"), (903, text("aa", 120).upper(), "日本", 1, "x"), (5, rows[5][1], "aa", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, s int, l string")
    sizes = collections.Counter(v for _, _, v, *_ in rows if v is not None)
    name = lambda v: v if sizes[v] >= 20 else ""
    held = collections.defaultdict(collections.Counter)
    for _, t, v, *_ in rows:
        held[name(v)].update({w.lower() for w in WORD.findall(t or "")})
    frequent = {k: sorted(c, key=lambda w: (-c[w], w.encode()))[:12] for k, c in held.items()}
    table = []
    for i, t, v, *_ in rows:
        w = WORD.findall(t or "")
        l = name(v)
        c = collections.Counter(x.lower() for x in w)
        f = [c[k] for k in frequent[l]]
        trio = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for k in range(len(w) - 2) if trio[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        table.append([i, l, len(w), share(classes(t or "")), share([*f, len(w) - sum(f)]), len(w) < 50 or 100 * len(again) > 50 * len(w)])

    def means(use):
        return {l: tuple(np.mean([x[k] for x in use if x[1] == l], axis=0) for k in (3, 4)) for l in {x[1] for x in use}}

    good = [x for x in table if not x[5]]
    far = lambda x, m: (distance(x[3], m[x[1]][0]), distance(x[4], m[x[1]][1]))
    m = means(good)
    joint = {id(x): math.hypot(*far(x, m)) for x in good}
    mean = {l: np.mean([joint[id(x)] for x in good if x[1] == l]) for l in m}
    m = means([x for x in good if joint[id(x)] <= mean[x[1]] + 1e-12])
    want = collections.Counter()
    for x in table:
        js = far(x, m)
        want[x[0], round(js[0], 6), round(js[1], 6), not x[5] and math.hypot(*js) <= 0.2 + 1 / math.sqrt(x[2])] += 1
    got = rules.judge(docs).collect()
    assert collections.Counter((q["id"], round(q["js_char"], 6), round(q["js_word"], 6), q["kept"]) for q in got) == want
    assert {q["reference"] for q in got} == {"aa", "bb", "日本", ""} and not next(q for q in got if q["id"] == 902)["kept"]


def test_many_languages_have_references_of_their_own(spark, monkeypatch):
    """600 languages, by a broadcast table and looked up; every one is judged by its own words."""
    r = random.Random(9)
    rows = []
    for k in range(600):
        own = [f"w{k}x{j}" for j in range(5)]
        rows += [(25 * k + i, " ".join(r.choice(own) if r.random() < 0.5 else f"q{r.randint(0, 5000)}" for _ in range(60)), f"lang{k}") for i in range(21)]
        rows.append((25 * k + 22, " ".join(f"z{r.randint(0, 9)}" + "ABC"[j % 3] * 4 for j in range(60)), f"lang{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = rules.judge(docs).toPandas().set_index("id").sort_index()
    assert got.reference.nunique() == 600 and (got.reference == [v for _, _, v in sorted(rows)]).all()
    assert got.js_word[[25 * k for k in range(600)]].max() < 0.5 < got.js_word[[25 * k + 22 for k in range(600)]].min()
    plan = rules.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
    monkeypatch.setattr(shared, "BROADCAST", 0)
    far = rules.judge(docs).toPandas().set_index("id").sort_index()
    assert (far.kept == got.kept).all() and np.allclose(far.js_word, got.js_word) and np.allclose(far.js_char, got.js_char)


def test_without_a_reference_the_base_rules_decide(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "ja"), (2, "a b", "ja"), (3, None, None)], "doc_id long, text string, lang string")
    got = {r["id"]: r for r in rules.judge(d).collect()}
    assert got[1]["kept"] and got[1]["js_char"] is None and not got[2]["kept"] and got[3]["base_failed"]

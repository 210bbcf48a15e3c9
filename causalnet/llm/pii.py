"""Personal data: base rules, and spans that boosted trees select from high-recall candidates.

All of the main path is Column expressions: patterns, span arithmetic, features and trees. Only the
fit (once a session, on a bounded generated table) happens on the driver.

Defined cases: a null text is empty and has no spans (and stays null where texts are rewritten); null ids
keep their row; repeated rows repeat; long texts are searched whole (patterns run in linear time:
possessive, and anchored where a run begins or the last match ended); of an added span and a base span
that overlap the base span stays, and a probability equal to the threshold is enough; where rewritten
spans overlap, the first names them all; extra columns of any name stay as they are; an empty table
gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalnet.llm import boosting

LOCAL = "A-Za-z0-9._%+-"
#: Kind -> pattern, in the order of the span list. Equal in matches to the plain greedy forms:
#: a match can only begin where a run of its first class begins or where the last match ended.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators; their spans may overlap each other.
CANDIDATES = {
    "secret": r"(?:(?<![A-Za-z0-9_+/=-])|\G)[A-Za-z0-9_+/=-]{16,}+",
    "number": r"(?:(?<![A-Za-z0-9])|\G)[0-9](?:[\x20.-]?[0-9]){6,}+",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
CONTEXT = 32
#: Code points of a block of text, where spans are replaced.
BLOCK = 4096
ASKS = r"(?i)(?:token|secret|passw|api|key|auth|bearer|credential)"
PERSON = r"(?i)(?:phone|tel|call|mobile|fax|ssn|social|iban|account|card|passport|licen[cs]e no)"
OTHER = r"(?i)(?:order|version|item|isbn|page|part|sku|serial|commit|hash|sha|checksum|md5|ticket|build|issue|figure|section|year|total)"
FEATURES = ("kind", "len", "digits", "uppers", "hex", "distinct", "marks", "luhn", "asks", "person", "other", "assigned", "quoted", "glued")
#: Generated sentences for learning, and the precision that the threshold must reach on families not learned from.
LEARN = 3000
PRECISION = 0.99


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column, block: int = 64) -> Column:
    """Sums of all before each element, by blocks: near-linear in the number of elements."""

    def with_sums(x: Column) -> Column:
        n = F.size(x)
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(x, b * block + 1, F.lit(block))))
        return let(
            blocks,
            lambda b: let(
                F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i))),
                lambda p: F.transform(x, lambda _, i: F.element_at(p, F.floor(i / block).cast("int") + 1) + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block))),
            ),
        )

    return let(lengths, lambda x: F.when(F.size(x) > 0, with_sums(x)).otherwise(F.array().cast("array<int>")))


SPAN = "array<struct<kind:int,s:string,start:int,end:int,pre:string,post:string>>"


def matches(text: Column, pattern: str, kind: int, guard: Column) -> Column:
    """All leftmost non-overlapping matches with code-point positions and nearby text."""

    def found(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        sizes = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.char_length(h) + F.char_length(g))
        at = running(sizes)
        rows = F.arrays_zip(hits.alias("h"), F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), F.slice(gaps, F.lit(2), F.size(hits)).alias("p"), at.alias("a"))
        return F.transform(
            rows,
            lambda r: let(
                r["a"] + F.char_length(r["g"]),
                lambda s: F.struct(F.lit(kind).alias("kind"), r["h"].alias("s"), s.alias("start"), (s + F.char_length(r["h"])).alias("end"), F.right(r["g"], F.lit(CONTEXT)).alias("pre"), F.left(r["p"], F.lit(CONTEXT)).alias("post")),
            ),
        )

    none = F.array().cast(SPAN)
    hits = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps")), found).cast(SPAN)).otherwise(none))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda d, i: let(F.substring(d, i, F.lit(1)).cast("int"), lambda v: F.when(i % 2 == 0, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v))
    return let(F.reverse(digits), lambda d: F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(d)), lambda i: value(d, i)), F.lit(0), lambda s, v: s + v) % 10 == 0)


CHECKED = ("ip", "card", "phone")


def checker(kind: str):
    return lambda m: valid(kind, m["s"])


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return ~s.rlike(r"(?<![0-9])0*+(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?![0-9])")
    if kind == "card":
        return let(digits_of(s), lambda d: F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(False))
    return F.char_length(digits_of(s)).between(8, 15)


def base_spans(text: Column) -> Column:
    """One array a kind, in the order of BASE; ``text`` must not be null."""
    digit = text.rlike("[0-9]")
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        got = matches(text, pattern, k, text.contains("@") if name == "email" else digit)
        out.append(got if name not in CHECKED else F.filter(got, checker(name)))
    return F.concat(*out)


def features(m: Column) -> Column:
    s, pre, post = m["s"], m["pre"], m["post"]
    flag = lambda c: c.cast("double")
    count = lambda p: F.char_length(F.regexp_replace(s, p, "")).cast("double")
    return F.struct(
        m["kind"].cast("double").alias("kind"),
        F.char_length(s).cast("double").alias("len"),
        count("[^0-9]").alias("digits"),
        count("[^A-Z]").alias("uppers"),
        flag(s.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        F.size(F.array_distinct(F.split(s, ""))).cast("double").alias("distinct"),
        count("[A-Za-z0-9]").alias("marks"),
        flag(let(digits_of(s), lambda d: F.when(F.char_length(d) > 1, luhn(d)).otherwise(False))).alias("luhn"),
        flag(pre.rlike(ASKS)).alias("asks"),
        flag(pre.rlike(PERSON)).alias("person"),
        flag(pre.rlike(OTHER)).alias("other"),
        flag(pre.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(pre.rlike("[\"']$") & post.rlike("^[\"']")).alias("quoted"),
        flag(pre.rlike(r"[\p{L}\p{N}.]$") | post.rlike(r"^[\p{L}\p{N}]")).alias("glued"),
    )


def candidates(text: Column) -> Column:
    """Spans of all generators; kinds count on from those of BASE."""
    digit, long = text.rlike("[0-9]"), text.rlike("[A-Za-z0-9_+/=-]{16}")
    return F.concat(*(matches(text, p, len(BASE) + k, long if name == "secret" else digit) for k, (name, p) in enumerate(CANDIDATES.items())))


def _examples(n: int, seed: int = 7) -> list[tuple[int, str, bool, int]]:
    """(i, sentence, private, family): generated sentences with one string each that is private or only looks
    so. A family is a form with a cue; many cues are in none of the feature lists."""
    r = random.Random(seed)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorstlhdu") for _ in range(r.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    wide = lambda k: "".join(r.choice(base64) for _ in range(k))
    quote = lambda s: r.choice([f'"{s}"', f"'{s}'", s])
    cued = lambda cues, form: [(lambda c=c: f"{c}{form()}") for c in cues]
    keys = ["token", "api_key", "secret", "password", "TOKEN", "auth key", "access_token", "signing", "webhook", "session", "login", "clef", "Kennwort", "clave", "bearer", "credential", "pin code", "client"]
    given = lambda v: r.choice([" = ", ": ", "=", ":"]) + quote(v())
    calls = ["phone ", "call ", "tel: ", "mobile ", "fax ", "reach me at ", "llamar al ", "appelez le ", "ring ", "", "Telefon ", "office ", "home "]
    people = ["ssn ", "social security ", "id ", "", "insured ", "member ", "file of "]
    banks = ["iban ", "account ", "", "pay to ", "compte ", "Konto ", "transfer: "]
    cards = ["card ", "account ", "passport ", "card no ", "passport no. "]
    goods = ["order ", "item ", "part ", "sku ", "serial ", "ticket ", "total ", "", "invoice ", "pedido ", "Nummer ", "stock ", "about "]
    sums = ["commit ", "sha ", "checksum ", "md5 ", "hash ", "checksum: ", "sha256=", "commit=", "build hash ", "hash: "]
    yes = [
        *cued(keys, lambda: given(lambda: hexes(r.choice([20, 24, 32, 40, 64])))), *cued(keys, lambda: given(lambda: hexes(40).upper())), *cued(keys, lambda: given(lambda: wide(r.randint(20, 60)))),
        *cued(calls, lambda: f"({d(3)}) {d(3)}-{d(4)}"), *cued(calls, lambda: f"{d(3)}-{d(3)}-{d(4)}"), *cued(calls, lambda: f"{d(3)}.{d(3)}.{d(4)}"), *cued(calls, lambda: f"{d(3)} {d(3)} {d(4)}"),
        *cued(people, lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        *cued(banks, lambda: r.choice(["DE", "FR", "ES", "GB"]) + d(20)), *cued(banks, lambda: r.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(" " + d(4) for _ in range(4)) + " " + d(2)),
        *cued(cards, lambda: d(r.choice([9, 12, 16]))),
    ]
    no = [
        *cued(goods, lambda: d(r.randint(7, 14))), *cued(goods, lambda: f"{d(4)} {d(4)} {d(4)}"),
        *cued(sums, lambda: hexes(r.choice([32, 40, 64]))),
        *cued(["version ", "build ", "section ", "v", "release "], lambda: ".".join(d(r.randint(1, 3)) for _ in range(4)) + "." + d(3)),
        *cued(["", "see ", "the ", "name: ", "path = ", "tag="], lambda: "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(16, 40)))),
        *cued(["", "see ", "the ", "slug: ", "page "], lambda: "-".join(word() for _ in range(4)) + "-" + d(r.randint(1, 4))),
        *cued(["year ", "page ", "figure ", "on ", "le ", ""], lambda: f"{d(4)}-{d(2)}-{d(2)}"),
        *cued(["", "rule ", "a"], lambda: "=" * r.randint(16, 40)), *cued(["", "menu ", "a"], lambda: "-" * r.randint(16, 40)),
    ]
    out = []
    for i in range(n):
        private = r.random() < 0.5
        k = r.randrange(len(yes if private else no))
        out.append((i, f"{line()} {(yes if private else no)[k]()} {line()} 7", private, 2 * k + private))
    return out


_fitted: dict[tuple, tuple[boosting.Boosted, float]] = {}


def learned(spark: SparkSession, rows: int = LEARN, precision: float = PRECISION) -> tuple[boosting.Boosted, float]:
    """The trees and their threshold, once for an application.

    Families of generated sentences are dealt to three parts: the trees learn from one, are calibrated on
    the second, and the threshold is the least that reaches ``precision`` on the third, or an error."""
    key = (spark.sparkContext.applicationId, rows, precision)
    if key not in _fitted:
        table = spark.createDataFrame(_examples(rows), "i int, t string, y boolean, f int").coalesce(1)
        got = table.select("i", "y", "f", F.explode(F.transform(candidates(F.col("t")), features)).alias("x")).select("i", "y", "f", "x.*").orderBy("i", "kind").collect()
        x = np.array([[r[f] for f in FEATURES] for r in got])
        y = np.array([r["y"] for r in got], float)
        part = np.array([(r["f"] // 2) % 5 for r in got])
        fit, second, third = part < 3, part == 3, part == 4
        model = boosting.calibrate(boosting.fit(x[fit], y[fit], FEATURES), x[second], y[second])
        _fitted[key] = model, threshold_for(1 / (1 + np.exp(-(model.margin(x[third]) * model.slope + model.shift))), y[third], precision)
    return _fitted[key]


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from 0.5 on from which the share of private strings is ``precision`` or more."""
    for t in np.linspace(0.5, 0.995, 100):
        if (p >= t).any() and y[p >= t].mean() >= precision:
            return float(t)
    raise ValueError(f"no threshold reaches a precision of {precision}")


def spans(text: Column, model: boosting.Boosted, threshold: float) -> Column:
    """array of (kind, start, end): base spans in order, then selected candidates in order."""
    plain = lambda a: F.transform(a, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    added = F.filter(candidates(text), lambda m: let(features(m), lambda x: model.column(x) >= F.lit(threshold)))

    def apart(b: Column) -> Column:
        """Base spans, and the added ones that no base span overlaps."""
        return F.concat(plain(b), plain(F.filter(added, lambda m: ~F.exists(b, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])))))

    return let(base_spans(text), apart)


NAMES = (*BASE, *CANDIDATES)


def named(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), kind + 1)


def find(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end); start and end count code points, end exclusive."""
    model, threshold = learned(docs.sparkSession)
    return docs.withColumn(out_col, let(F.coalesce(F.col(text_col).cast("string"), F.lit("")), lambda t: spans(t, model, threshold)))


def reached(ends: Column, block: int = 64) -> Column:
    """0, then the greatest of all ends up to each, by blocks: near-linear in their number."""
    top = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    n = F.size(ends)
    tops = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / block).cast("int"))), lambda b: top(F.slice(ends, b * block + 1, F.lit(block))))
    return let(tops, lambda b: F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(top(F.slice(b, F.lit(1), F.floor(i / block).cast("int"))), top(F.slice(ends, F.floor(i / block).cast("int") * block + 1, i % block)))))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans merge."""
    from causalnet.llm.shared import fresh

    (c,) = fresh(docs, "spans")

    def rewrite(t: Column, s: Column) -> Column:
        order = F.array_sort(F.transform(s, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
        # Blocks of a fixed number of code points, so that a slice costs its own length, wherever it lies.
        blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

        def cut(b: Column, start: Column, end: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            parts = F.slice(b, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
            return F.when(end <= start, F.lit("")).otherwise(F.substring(F.array_join(parts, ""), start - first * BLOCK + 1, end - start))

        def pieces(b: Column, o: Column, reach: Column) -> Column:
            """What lies before each span that begins behind all former ones, and its kind; then the rest."""
            body = F.transform(o, lambda m, i: let(F.element_at(reach, i + 1), lambda at: F.when(m["start"] < at, F.lit("")).otherwise(F.concat(cut(b, at, m["start"]), F.lit("["), F.upper(named(m["kind"])), F.lit("]")))))
            return F.concat(F.array_join(body, ""), cut(b, F.element_at(reach, -1), F.char_length(t)))

        return let(order, lambda o: let(reached(F.transform(o, lambda m: m["end"])), lambda reach: let(blocks, lambda b: pieces(b, o, reach))))

    found = find(docs, text_col, c)
    text = F.col(text_col)
    return found.withColumn(text_col, F.when(F.size(c) > 0, rewrite(text, F.col(c))).otherwise(text)).select(*docs.columns)

"""Counts of a whole text, as Column expressions of the JVM only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from causalnet.llm.pii import let
from causalnet.llm.shared import SPACE, WORD

#: Character classes in the order in which they are taken out of a text; what remains is "other".
CLASSES = {"lower": "[a-z]+", "space": r"\s+", "high": r"[^\x00-\x7F]+", "upper": "[A-Z]+", "stop": r"[.,;:!?'\"()\-]+", "digit": "[0-9]+"}
#: Frequent words of each language. Fixed values.
COMMON = {
    "en": "the of and to in a is that for it on was",
    "de": "der die und den des von das mit im zu für auf",
    "fr": "de la le et les des que un en une du est",
    "es": "de la que el en y los del se las por un",
}
COMMON = {k: v.split() for k, v in COMMON.items()}
ALL_COMMON = sorted({w for v in COMMON.values() for w in v})
LONGEST = max(map(len, ALL_COMMON))
#: Up to so many distinct repeated windows are searched one by one; more are found by a sort. Both are exact.
FEW = 16


def class_counts(text: Column) -> Column:
    """struct of the characters of each class, each pass over what the former left."""
    names = list(CLASSES)

    def take(k: int, rest: Column, before: Column, got: list[Column]) -> Column:
        if k == len(names):
            return F.struct(*(c.alias(n) for c, n in zip(got, names)), before.alias("other"))
        return let(
            F.regexp_replace(rest, CLASSES[names[k]], ""),
            lambda r: let(F.char_length(r), lambda n: take(k + 1, r, n, [*got, before - n])),
        )

    return let(F.char_length(text), lambda n: take(0, text, n, []))


def covered(at: Column, width: int) -> Column:
    """How many places the windows that begin at the ascending ``at`` cover."""
    return let(
        at,
        lambda p: F.when(F.size(p) == 0, 0).otherwise(
            F.aggregate(F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(width))), F.lit(width), lambda s, v: s + v)
        ),
    )


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, first occurrences included.

    Windows are compared by a 64-bit hash; where that finds repeats, the windows' words decide."""
    window = lambda w, i: F.concat_ws(" ", *(F.element_at(w, i + k) for k in range(width)))

    def exact(w: Column, at: Column, distinct: Column) -> Column:
        """Those of ``at`` whose words repeat; only a hash collision makes a difference."""
        return let(
            F.transform(at, lambda i: window(w, i)),
            lambda t: F.when(F.size(F.array_distinct(t)) == distinct, at).otherwise(F.filter(at, lambda i: F.size(F.filter(t, lambda x: x == window(w, i))) > 1)),
        )

    def by_search(w: Column, h: Column) -> Column:
        repeats = let(
            F.sort_array(h),
            lambda s: F.array_distinct(F.filter(F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1) == x), x)), lambda x: x.isNotNull())),
        )
        return let(
            repeats,
            lambda d: F.when(
                F.size(d) <= FEW,
                exact(w, F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i + 1)), lambda i: i.isNotNull()), F.size(d)),
            ).otherwise(exact(w, by_sort(h), F.size(d))),
        )

    def by_sort(h: Column) -> Column:
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(
                F.filter(
                    F.transform(s, lambda x, i: F.when(((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]), x["i"] + 1)),
                    lambda i: i.isNotNull(),
                )
            ),
        )

    def run(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(width))))
        return F.when(F.size(w) < width, 0).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(by_search(w, h), width)))
        )

    return let(words, run)


def common_counts(words: Column) -> Column:
    """array of how often each word of ALL_COMMON occurs, in any case."""
    short = F.transform(F.filter(words, lambda w: F.octet_length(w) <= LONGEST + 1), lambda w: F.lower(w))

    def count(s: Column) -> Column:
        return F.array(*(F.size(s) - F.size(F.array_remove(s, w)) for w in ALL_COMMON))

    return let(short, count)


def text_counts(text: Column, more: Callable[[Column], list[Column]] = lambda words: []) -> Column:
    """One struct of the base counts and of ``more`` of the array of words; a null text counts as empty."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return let(
            F.struct(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"), lines.alias("l"), class_counts(t).alias("c")),
            lambda x: F.struct(
                F.char_length(t).cast("long").alias("n_chars"),
                F.size(x["w"]).cast("long").alias("n_words"),
                F.char_length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
                F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                F.size(x["l"]).cast("long").alias("n_lines"),
                (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
                repeated_words(x["w"]).cast("long").alias("n_repeat_words"),
                F.array(*(x["c"][n] for n in (*CLASSES, "other"))).alias("classes"),
                *more(x["w"]),
            ),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def text_stats(text: Column) -> Column:
    """The base counts, the number of distinct words, and how often each word of ``ALL_COMMON`` occurs."""
    return text_counts(text, lambda w: [F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"), common_counts(w).alias("common")])

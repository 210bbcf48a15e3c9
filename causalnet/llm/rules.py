"""Quality rules: fixed base rules, then divergence from a language's reference.

A text's histograms (character classes; its language's frequent words against all others) are compared
with the language's references by Jensen-Shannon distance. All references come from the table: the
frequent words of a language are those that most of its documents hold, and its histograms are means
over its documents that pass the base rules, taken once more over those no further than the mean
distance. Documents of no language and of a language with under ``LEAST_DOCUMENTS`` documents
are taken together and have references of their own, learned from
them alike; where they too are fewer, there is no reference, and the base rules decide alone. The verdict
is the joint distance against a limit with an allowance of 1/sqrt(words), so short texts are not judged on
noise; below the least number of words the base rules have already decided.

Main path: Column expressions and grouped aggregation only. References are tables with a row per
language, joined to the documents (``shared.beside``); there may be any number of languages.

Defined cases: null texts have no words and fail; whole texts are counted, however long; frequent words that tie go by code point; a distance equal to its limit is kept; null ids
and repeated rows keep their rows; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalnet.llm.pii import let
from causalnet.llm.shared import SPACE, beside, durable
from causalnet.llm.textstats import CLASSES, text_counts

LEAST_WORDS = 50
LIMIT = 0.2
ALLOWANCE = 1.0
#: Frequent words of a reference.
FREQUENT = 12
LEAST_DOCUMENTS = 20
#: The language of whatever has no reference of its own.
OTHERS = ""


def histogram(counts: Column) -> Column:
    """Shares of an array of counts; all zero stays zero."""
    return let(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v), lambda n: F.transform(counts, lambda v: F.when(n > 0, v / n).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance (square root, base 2) of two arrays of shares."""

    def part(a: Column, m: Column) -> Column:
        return F.when((a > 0) & (m > 0), a * F.log2(F.when((a > 0) & (m > 0), a / m).otherwise(1.0))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: let((a + b) / 2, lambda m: part(a, m) + part(b, m)))
    total = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2
    return F.sqrt(F.when(total > 0, total).when(total <= 0, 0.0))


def with_language(docs: DataFrame, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with l_, the language that judges each; the durable table (l_) of those that have a reference).

    ``OTHERS`` stands for all languages of too few documents, and has a reference if they are enough together."""
    named = docs.withColumn("l_", F.coalesce(F.col(lang_col).cast("string"), F.lit(OTHERS)))
    sizes = durable(named.groupBy("l_").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    own = durable(sizes.where((F.col("n") >= LEAST_DOCUMENTS) & (F.col("l_") != OTHERS)).select("l_", F.lit(True).alias("own_")), "languages")
    rest = beside(sizes, own, "l_").where(F.col("own_").isNull()).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select(F.lit(OTHERS).alias("l_"))
    tagged = beside(named, own, "l_").withColumn("l_", F.when(F.col("own_"), F.col("l_")).otherwise(F.lit(OTHERS))).drop("own_")
    return tagged, durable(own.select("l_").unionByName(rest), "references")


def frequent_words(docs: DataFrame, text_col: str, named: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(l_, own, longest): the words that most documents of each language hold (in any case), the most common first, and the most
    bytes that a word of any case may have to be one of them. Durable.

    First the best within parts of a language's vocabulary, then over the parts, so no task sorts one whole."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), SPACE))
    judged = beside(docs.select("l_", F.col(text_col)), named.withColumn("has_", F.lit(True)), "l_").where("has_")
    each = judged.select("l_", F.explode(words).alias("w")).where(F.col("w") != "").groupBy("l_", "w").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("w")]
    inside = Window.partitionBy("l_", F.pmod(F.xxhash64("w"), F.lit(256))).orderBy(*order)
    near = each.withColumn("at", F.row_number().over(inside)).where(F.col("at") <= most)
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("l_").orderBy(*order))).where(F.col("at") <= most)
    lists = best.groupBy("l_").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("best"), F.max(F.octet_length("w")).alias("longest"))
    # In lower case a word has a third of its bytes at least.
    return durable(lists.select("l_", F.transform("best", lambda b: b["w"]).alias("own"), (3 * F.col("longest")).alias("longest")), "frequent-words")


def word_counts(words: Column, own: Column, longest: Column) -> Column:
    """array of how often each frequent word of the text's language occurs (in any case), then all other words."""
    return let(
        F.struct(own.alias("o"), F.size(words).alias("n"), F.transform(F.filter(words, lambda w: F.octet_length(w) <= longest), lambda w: F.lower(w)).alias("w")),
        lambda x: let(
            F.transform(x["o"], lambda k: F.size(F.filter(x["w"], lambda w: w == k))),
            lambda c: F.concat(c, F.array(x["n"] - F.aggregate(c, F.lit(0), lambda s, v: s + v))),
        ),
    )


def reference(rows: DataFrame) -> DataFrame:
    """(l_, rc, rw): mean histograms by language, durable. A language with fewer words than others has zeros at the end."""
    nc, nw = len(CLASSES) + 1, FREQUENT + 1
    mean = lambda c, n: F.array(*(F.coalesce(F.avg(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)))
    return durable(rows.groupBy("l_").agg(mean("pc", nc).alias("rc"), mean("pw", nw).alias("rw")), "reference")


def with_distance(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds js_char, js_word (null without a reference)."""
    near = beside(rows, refs, "l_")
    return near.withColumns({"js_char": jensen_shannon(F.col("pc"), F.col("rc")), "js_word": jensen_shannon(F.col("pw"), F.col("rw"))}).drop("rc", "rw")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: float = LIMIT, allowance: float = ALLOWANCE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row: id, the base counts, base_failed, js_char, js_word, kept."""
    tagged, named = with_language(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t_"), F.col(lang_col).alias("lang_")), "lang_")
    spoken = beside(tagged, frequent_words(tagged, "t_", named), "l_")
    counts = text_counts(F.col("t_"), lambda w: [word_counts(w, F.col("own"), F.col("longest")).alias("common")])
    s = durable(spoken.select("id", "l_", counts.alias("s")), "text-stats")
    failed = (F.col("s.n_words") < least_words) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))
    rows = s.withColumn("pc", histogram(F.col("s.classes"))).withColumn("pw", histogram(F.col("s.common"))).withColumn("base_failed", failed)
    joint = F.sqrt(F.col("js_char") ** 2 + F.col("js_word") ** 2)
    good = beside(rows.where(~F.col("base_failed")), named.withColumn("has_", F.lit(True)), "l_").where("has_").drop("has_")
    near = with_distance(good, reference(good)).withColumn("j", joint)
    middle = durable(near.groupBy("l_").agg(F.avg("j").alias("m")), "distances")
    refs = reference(beside(near, middle, "l_").where(F.col("j") <= F.col("m") + F.lit(1e-12)))  # at least the nearest of each
    kept = ~F.col("base_failed") & F.coalesce(joint <= limit + allowance / F.sqrt(F.col("s.n_words").cast("double")), F.lit(True))
    return with_distance(rows, refs).select("id", F.col("l_").alias("reference"), "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "js_char", "js_word", kept.alias("kept"))

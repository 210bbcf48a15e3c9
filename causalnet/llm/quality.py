"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A boosted classifier of whole-text counts gives each document's evidence; where a label exists it is
the evidence at its site. Evidence is summed by path (host and section) and by host. A host's
posterior shrinks toward the global mean, a path's toward its host, with strengths estimated from the
spread of sites (method of moments), so sparse sites stay near their prior. A document's posterior
odds are its own times the site's against the global odds, the site's part tempered by ``site_weight``;
its own evidence is left out of its sites', so the only document of a site has that site's prior.

Defined cases: null texts are empty texts; whole texts are counted, however long; null hosts and
sections are sites of their own; without labels of both classes every document has the same evidence
and all are kept; of several labels of one id the greatest holds; a posterior equal to ``keep`` is
kept; null ids and repeated rows keep their rows; extra columns of any name stay as they are; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.llm import boosting
from causalnet.llm.shared import durable, first_by_hash, join_back, lookup, row_hash
from causalnet.llm.textstats import CLASSES, text_stats

#: Labelled rows, the first by a hash of their id, from which the classifier learns.
LEARN = 20_000
SITE_WEIGHT = 0.25
KEEP = 0.5
CLASS_NAMES = (*CLASSES, "other")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "common", *(f"c_{n}" for n in CLASS_NAMES))


def feature_struct(s: Column) -> Column:
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["n_chars"], F.lit(1)).cast("double")
    return F.struct(
        F.log1p(s["n_words"].cast("double")).alias("log_words"),
        (s["word_chars"] / n).alias("word_length"),
        (s["n_symbols"] / n).alias("symbols"),
        (s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))).alias("dup_lines"),
        (s["n_repeat_words"] / n).alias("repeats"),
        (s["n_distinct_words"] / n).alias("distinct"),
        (F.aggregate(s["common"], F.lit(0), lambda a, v: a + v) / n).alias("common"),
        *((F.get(s["classes"], F.lit(i)) / chars).alias(f"c_{k}") for i, k in enumerate(CLASS_NAMES)),
    )


def learn(x: np.ndarray, y: np.ndarray) -> boosting.Boosted:
    """Trees on three quarters of the rows, calibrated on the rest."""
    own = np.arange(len(y)) % 4 == 3
    if len(np.unique(y)) < 2 or len(np.unique(y[~own])) < 2 or len(np.unique(y[own])) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return boosting.Boosted(FEATURES, float(np.log((share + 1e-3) / (1 - share + 1e-3))), ())
    return boosting.calibrate(boosting.fit(x[~own], y[~own], FEATURES, rounds=40), x[own], y[own])


def strength(mean: float, between: float, noise: float) -> float:
    """Pseudo-documents of a Beta prior whose mean and spread match the sites'."""
    spread = max(between - noise, 1e-4)
    return float(np.clip(mean * (1 - mean) / spread - 1, 2.0, 1e4))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", learn_rows: int = LEARN, site_weight: float = SITE_WEIGHT, keep: float = KEEP) -> DataFrame:
    """(id, th, host, path, evidence, host_posterior, path_posterior, posterior, kept) of every row; th is its ``row_hash``.

    The posteriors of a row's sites leave out the row itself."""
    s = durable(
        docs.select(
            F.col(id_col).alias("id"), row_hash(docs).alias("th"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), text_stats(F.col(text_col)).alias("s")
        ).withColumn("x", feature_struct(F.col("s"))).drop("s"),
        "quality-features",
    )
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = first_by_hash(s.join(marks, "id").withColumn("h", F.xxhash64("id")), "h", learn_rows)
    rows = known.orderBy("h", "id", "th").limit(learn_rows).select("x.*", "y").collect()
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows]).reshape(-1, len(FEATURES))
    model = learn(x, np.array([r["y"] for r in rows], float))
    return site_posteriors(s.join(marks, "id", "left").select("id", "th", "host", "path", "y", model.column(F.col("x")).alias("evidence")), site_weight, keep)


def site_posteriors(scored: DataFrame, site_weight: float = SITE_WEIGHT, keep: float = KEEP) -> DataFrame:
    """Combine (id, th, host, path, y, evidence) with the posteriors of host and path; y is a label or null."""
    own = F.coalesce("y", "evidence")
    scored = durable(scored.select("*", F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("hz"), F.coalesce("path", F.lit("")).alias("p"), F.col("path").isNull().alias("pz")), "quality-evidence")
    site, at = ["h", "hz"], ["h", "hz", "p", "pz"]
    paths = durable(scored.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("e")), "quality-paths")
    hosts = paths.groupBy(*site).agg(F.sum("n").alias("hn"), F.sum("e").alias("he"), F.count(F.lit(1)).alias("c"))
    hosts = durable(hosts, "quality-hosts")
    moments = lambda t, n, e: t.agg(F.sum(n).alias("n"), F.sum(e).alias("e"), F.coalesce(F.var_pop(F.col(e) / F.col(n)), F.lit(0.0)).alias("v"), F.coalesce(F.avg(1 / F.col(n)), F.lit(1.0)).alias("i")).collect()[0]
    h, p = moments(hosts, "hn", "he"), moments(paths, "n", "e")
    mean = float(np.clip((h["e"] or 0.0) / max(h["n"] or 0, 1), 1e-3, 1 - 1e-3))
    noise = mean * (1 - mean)
    kh, kp = strength(mean, h["v"], noise * h["i"]), strength(mean, p["v"], noise * p["i"])
    sites = lookup(paths, hosts.drop("c"), site, counts=hosts.select(*site, F.col("c").alias("n")))
    joined = lookup(scored, sites, at, counts=paths.select(*at, "n"))
    host_posterior = (F.lit(kh * mean) + F.col("he") - own) / (F.lit(kh) + F.col("hn") - 1)
    path_posterior = (kp * F.col("host_posterior") + F.col("e") - own) / (F.lit(kp) + F.col("n") - 1)
    safe = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(safe(c) / (1 - safe(c)))
    z = logit(F.col("evidence")) + site_weight * (logit(F.col("path_posterior")) - F.lit(float(np.log(mean / (1 - mean)))))
    out = joined.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior).withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.select("id", "th", "host", "path", "evidence", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= keep).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with their own columns, that the classifier keeps."""
    judged = classify(docs, labels, id_col, text_col, **options)
    return join_back(docs, judged.where("not kept").select("id", "th").distinct(), "left_anti", id_col)

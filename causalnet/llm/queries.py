"""One thin query per operator: production parameters over whole tables, digest columns of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from causalnet.llm import filter_audit, infill, langid, media, mixing, packing, pii, quality, rules, simhash, substring, token_ids, vectors
from causalnet.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "table", "tokenizer_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "host", "path", "evidence", "host_posterior", "path_posterior", "posterior", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_ids.tokenize_to_shards(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_ids.read_token_ids(shards)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=4096, end_id=1)
    return packing.packed(pieces.drop("ids"), size=4096).drop("pid")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *((F.round(c, 6) + 0.0).alias(c) for c in ("js_char", "js_word")))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", (F.round("target", 6) + 0.0).alias("target"), (F.col("epochs") * F.col("size")).alias("taken"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = list(pii.BASE)
    text = lambda a: F.array_join(F.transform(a, lambda m: F.concat_ws(":", pii.named(m["kind"]), m["start"], m["end"])), ",")
    count = lambda s, k: F.size(F.filter(s, lambda m: m["kind"] == k)).cast("long")
    digest = pii.let(
        F.col("spans"),
        lambda s: F.struct(
            *(count(s, k).alias(f"n_{name}") for k, name in enumerate(kinds)),
            F.sha2(text(F.filter(s, lambda m: m["kind"] < len(kinds))), 256).alias("base_sha256"),
            text(s).alias("spans"),
        ),
    )
    return found.select("doc_id", digest.alias("d")).select("doc_id", "d.*")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(rows, filter_audit.FIVE)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return cut.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        sha("output").alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op6_language_id": op6_language_id,
    "op2_token_ids": op2_token_ids,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vectors": op13_vectors,
}

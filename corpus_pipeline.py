"""From raw documents to packed training sequences, in five durable stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again. A stage begins by deleting what former stages left on their way, but for what
its own input reads. All but the last return the columns of documents.

Defined cases, for every stage: extra columns stay, whatever their names, until the last stage, which
returns pieces; null ids, sources and languages are values like others (nulls last); an empty table
gives an empty table. A null or blank text is an empty document: the classifier judges it like any
other, all such documents are near copies of each other, it has no spans, the mix never takes it.
Repeated rows are judged and redacted alike; near-dedup keeps one of them; a mix of equal rows takes
each by itself. Ties: the least id stays, then the least hash of the whole row. Whole texts are used,
however long; only the last stage cuts, into pieces of ``PIECE`` tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from causalnet.llm import mixing, nearcopies, packing, pii, quality
from causalnet.llm.queries import table, tokenizer_path
from causalnet.llm.shared import delete, durable, made, release

#: Tokens of a sequence and of a piece at most; documents and attention cost (squared lengths) of a sequence.
SEQUENCE, PIECE, DOCUMENTS, COST = 4096, 2048, 64, 1.5 * 2048**2


#: Tables of former stages that are still there.
_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first clears away what former ones left: their results are written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = {x.rpartition("/")[0].partition(":")[2].lstrip("/") for x in docs.inputFiles()}
        gone = [t for t in _left if t.partition(":")[2].lstrip("/") not in reads]
        delete(spark, gone)
        release(spark)
        _left[:] = [t for t in _left if t not in gone]
        before = len(made)
        out = f(spark, docs, sf_dir)
        _left.extend(made[before:])
        return out

    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash and MinHash candidates of a 5-word Jaccard of 0.8 or more."""
    return nearcopies.drop_near_copies(docs)


@stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets."""
    return pii.redacted(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixed(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its ids and its place in a sequence; tokens, documents and attention cost bind."""
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), size=PIECE, end_id=1)
    return packing.packed(pieces, size=SEQUENCE, max_docs=DOCUMENTS, max_cost=COST, weights=(1.0, 1.0, 1.0), rule="dot").drop("pid")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trees, hashes and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = durable(f(spark, docs, sf_dir), f"stage-{name}")
        _left.append(made[-1])  # its reader is the next stage, after which it goes
    _left.remove(made[-1])
    delete(spark, _left)
    _left.clear()
    return docs

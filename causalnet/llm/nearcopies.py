"""Near copies of documents, by both of the package's candidate searches and one exact check.

Candidates are documents in one SimHash component (pigeonhole blocks, at most 4 differing bits) and
documents that share one of five MinHash values over their 5-word shingles, which misses a pair of
similarity 0.8 with probability 0.2^5; SimHash alone would miss most pairs below 0.95. All candidates
are verified by the exact Jaccard similarity of their 5-word shingles, and joined by connected components.

Defined cases: texts of one to four words have one shingle, all of it; null and blank texts are one
group; whole texts are read, however long; null ids come last in a group's order; of rows of one id
and text the one of least row hash stays, of equal rows one; extra columns stay as they are; an empty
table stays so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import connected_components, durable, join_back, release, row_hash, ship
from causalnet.llm.simhash import near_duplicates
from causalnet.llm.substring import BANDS, SIMILAR, WIDTH, crowded, fold, hashed, minhashes, packed_set, shingle_hashes, verified


def signature(text: str, bands: int = BANDS) -> tuple[int, list[int], int]:
    """(hash of all words, MinHash values, bytes); hashes are signed longs."""
    import xxhash

    words = fold(text)
    h = hashed(words)
    if not len(h):
        return 0, [], 0
    whole = xxhash.xxh64_intdigest(h.tobytes())
    shingles = shingle_hashes(h)
    keys = minhashes(shingles, np.array([0, len(shingles)]), bands)[:, 0].tolist()
    return whole - (1 << 64) if whole >> 63 else whole, keys, len(text)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(docs).alias("th"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [signature(t.as_py() or "", bands) for t in b.column("t")]
            h, keys, n = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), h, keys, n], ["id", "th", "h", "keys", "n"])

    return src.mapInArrow(run, "id long, th long, h long, keys array<long>, n long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row of each group: the one with the least (id, row hash), ids that are null last."""
    alike = near_duplicates(docs, id_col, text_col, width=WIDTH).select(F.col(id_col).alias("id"), "th", "component")
    release(docs.sparkSession)
    found = durable(signatures(docs, id_col, text_col), "signatures")
    at = F.struct(F.col("id").isNull().alias("z"), "id", "th")
    reps = durable(found.groupBy("h").agg(F.min(at).alias("k"), F.max("n").alias("n"), F.first("keys").alias("keys")), "distinct-texts")
    # The SimHash component of each distinct text, by the row that stands for it.
    key = lambda d, i, t: (F.coalesce(F.col(i), F.lit(0)).alias("i_"), F.col(i).isNull().alias("z_"), F.col(t).alias("t_"))
    named = alike.select(*key(alike, "id", "th"), "component").dropDuplicates(["i_", "z_", "t_"])
    own = reps.select(*key(reps, "k.id", "k.th"), "h", "n", "keys").join(named, ["i_", "z_", "t_"])
    pairs = own.select("h", "n", F.explode(F.array_distinct(F.concat("keys", F.array(F.xxhash64(F.lit("simhash"), "component"))))).alias("key"))
    crowd = crowded(pairs.where("n > 0"))
    wanted = reps.join(crowd.select("h").distinct(), "h", "left_semi").select("h", *key(reps, "k.id", "k.th"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i_"), F.col(id_col).isNull().alias("z_"), row_hash(docs).alias("t_"), F.col(text_col).cast("string").alias("body"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([packed_set(t.as_py()) for t in b.column("body")], pa.binary())], ["h", "shingles"])

    sets = wanted.join(texts, ["i_", "z_", "t_"]).select("h", "body").mapInArrow(shingled, "h long, shingles binary")
    sets = durable(sets.groupBy("h").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    release(docs.sparkSession)
    comp = connected_components(verified(crowd, sets, least)).withColumnRenamed("node", "h")
    first = reps.join(comp, "h", "left").groupBy(F.coalesce("component", "h").alias("c")).agg(F.min("k").alias("k")).select("k.id", "k.th")
    return join_back(docs, first, "left_semi", id_col, once=True)

"""SimHash near-duplicates by pigeonhole blocks.

Contract of ``near_duplicates``: every row of the input gives one row (its id, its fingerprint and
the least id of its component). Null or blank texts have fingerprint zero and link like any other.
Null ids keep their row and take their component's least id (null when it has none). Repeated rows
repeat. Whole texts are read, however long. Extra columns of any name are ignored; an empty table
gives an empty table. ``drop_near_duplicates`` keeps the row of least id, null ids last; of rows with
one id the one whose hash of all columns is least; of rows equal in all columns one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import connected_components, durable, join_back, lookup, row_hash, ship

#: 4 differing bits spoil at most 4 of 7 blocks, so a linked pair shares 3 whole blocks.
BLOCKS = 7
SHARED = 3
BITS = 4
#: Fingerprints of one block key compared in one task; longer runs are dealt out in pairs of chunks.
RUN = 20_000
#: Children of a node in the trees that stand for a component, so that no node is a hub.
BRANCHES = 8


def block_masks(blocks: int = BLOCKS, shared: int = SHARED) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), shared)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The whole text's SimHash as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp, th): fp the fingerprint as a signed long, th the row's hash."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(docs).alias("th"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), width) for x in b.column("t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), b.column("th")], ["id", "fp", "th"])

    return src.mapInArrow(run, "id long, fp long, th long")


def forest(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A tree per component of "at most ``bits`` differing bits", no node of it with many branches: (parent, child)."""
    left, parents, children = np.arange(len(fp)), [], []
    while len(left) > 1:
        found, left = [left[0]], left[1:]
        k = 0
        while k < len(found) and len(left):
            near = np.bitwise_count(fp[left] ^ fp[found[k]]) <= bits
            if near.any():
                found.extend(left[near])
                left = left[~near]
            k += 1
        own = fp[np.array(found)]
        parents.append(own[(np.arange(1, len(own)) - 1) // BRANCHES])
        children.append(own[1:])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (none, none)


def _runs(batches: Iterator[pa.RecordBatch], masks: np.ndarray, bits: int, most: int, small: int = 8):
    """Sorted (c, fp) rows -> links (kind 0) within each block key, and the chunks of runs longer
    than ``most`` (kind 1; b is then the key). Holds one run's unfinished chunk at most."""

    def table(kind, c, chunk, a, b):
        n = len(a)
        cols = [np.full(n, kind, np.int32), np.full(n, c, np.int32), np.full(n, chunk, np.int64), a.view(np.int64), b.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "c", "chunk", "a", "b"])

    def whole(c, fp):
        if len(fp) < 2:
            return
        key = fp & masks[c]
        new = np.flatnonzero((key[1:] != key[:-1]) | (c[1:] != c[:-1])) + 1
        starts, ends = np.append(0, new), np.append(new, len(fp))
        run, size = np.repeat(np.arange(len(starts)), ends - starts), np.repeat(ends - starts, ends - starts)
        for s in range(1, min(small, len(fp))):
            i = np.flatnonzero((run[s:] == run[:-s]) & (size[s:] <= small))
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= bits]
            yield table(0, 0, 0, fp[i], fp[i + s])
        for s, e in zip(starts, ends):
            if e - s > small:
                yield table(0, 0, 0, *forest(fp[s:e], bits))

    def chunk(c, fp):
        return table(1, c[0], chunks, fp, fp & masks[c[0]])

    c, fp, chunks = np.zeros(0, np.int32), np.zeros(0, np.uint64), 0
    for b in batches:
        c = np.concatenate([c, b.column("c").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(fp):
            continue
        key = fp & masks[c]
        if chunks:
            other = np.flatnonzero((key != key[0]) | (c != c[0]))
            if len(other):
                yield chunk(c[: other[0]], fp[: other[0]])
                c, fp, key, chunks = c[other[0] :], fp[other[0] :], key[other[0] :], 0
        other = np.flatnonzero((key != key[-1]) | (c != c[-1]))
        at = other[-1] + 1 if len(other) else 0
        yield from whole(c[:at], fp[:at])
        c, fp = c[at:], fp[at:]
        while len(fp) > most:
            yield chunk(c[:most], fp[:most])
            c, fp, chunks = c[most:], fp[most:], chunks + 1
    if chunks:
        yield chunk(c, fp)
    else:
        yield from whole(c, fp)


def links(distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS, most: int = RUN) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all within ``bits`` of each other:
    a spanning forest for every block key, never all pairs of a crowded one."""
    masks = block_masks(blocks, blocks - bits)
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("x")).select(F.col("x.c").alias("c"), F.col("x.k").alias("k"), "fp")
    plain = np.array(masks, np.uint64)
    found = dealt.repartition("c", "k").sortWithinPartitions("c", "k", "fp").select("c", "fp").mapInArrow(
        lambda it: _runs(it, plain, bits, most), "kind int, c int, chunk long, a long, b long"
    )
    found = durable(found, "simhash-links")
    edges = found.where("kind = 0").select("a", "b")
    crowd = found.where("kind = 1")
    if crowd.isEmpty():
        return edges
    width = crowd.groupBy("c", "b").agg((F.max("chunk") + 1).alias("n"))
    paired = crowd.join(width, ["c", "b"]).select(
        "c", "b", F.col("a").alias("fp"), "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    ).select("c", "b", "fp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def meet(pdf):
        import pandas as pd

        a, b = forest(pdf["fp"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return edges.unionByName(paired.groupBy("c", "b", "i", "j").applyInPandas(meet, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = BITS, blocks: int = BLOCKS, most: int = RUN) -> DataFrame:
    """(id_col, fingerprint, component_id, component, fp, th) of every row; th is its ``row_hash``."""
    prints = durable(fingerprints(docs, id_col, text_col, width), "fingerprints")
    groups = durable(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    comp = connected_components(links(groups.select("fp"), bits, blocks, most))
    named = durable(groups.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named-fingerprints")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = durable(lookup(named, least, ["component"]).select("fp", "component_id", "component"), "components")
    return lookup(prints, table, ["fp"], counts=groups.select("fp", "n")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", "fp", "th"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component: the one with the least (id, row hash), ids that are null last."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = found.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("id"), "th")).alias("k")).select("k.id", "k.th")
    return join_back(docs, first, "left_semi", id_col, once=True)

"""Vector best-fit packing of token pieces into sequences.

A piece uses three capacities of a sequence: tokens, document count and attention cost (its length
squared). Pieces are placed in falling order of their greatest share of a capacity; among the open
sequences that keep every capacity, the one with the least weighted norm of what would remain is taken
("norm"; sequences are opened as needed, which fills tokens tightly), or the one with the greatest
weighted dot product of need and remainder ("dot"; as many sequences as any packing needs are open from
the start, which keeps several binding capacities in balance). Ties take the sequence opened first.

Pieces are dealt at random to groups of about ``group`` pieces, each packed in one task, so memory is
bounded, hot sources do not matter, and each group leaves one part-filled sequence or so.

Defined cases: a null or empty text is one piece of its end id; whole texts are encoded, however long,
and texts longer than a piece may be, and only those, are cut; null ids keep their rows; repeated rows
are separate pieces; equal lengths go in the order of a hash; extra columns of any name are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import durable, ship
from causalnet.llm.tokens import encoder

GROUP = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Durable pieces: doc_id, piece, start, length, ids_crc32, ids (little-endian, 2 or 4 bytes an id), pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.kind)
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("t")):
                ids = np.concatenate([enc.encode(t.as_py()), end])
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    out.append((i, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.tobytes()))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return durable(src.mapInArrow(run, PIECES).withColumn("pid", F.monotonically_increasing_id()), "pieces")


def best_fit(lengths: np.ndarray, size: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences count from 0."""
    whole = np.array([size, max_docs, max_cost], float)
    needs = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / whole[:, None]
    slack = 1e-9
    if len(lengths) and needs.max() > 1 + slack:
        raise ValueError("a piece exceeds a whole sequence's capacity")
    order = np.lexsort((-lengths, -needs.max(axis=0)))
    least = needs.min(axis=1) if len(lengths) else np.zeros(3)
    w = np.asarray(weights, float)[:, None]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_open = made = lower_bound(lengths, size, max_docs, max_cost) if rule == "dot" else 0
    width = max(256, 2 * n_open)
    room = np.ones((3, width))  # of the open sequences, as shares of each capacity
    name, used = np.arange(width), np.zeros(width, np.int64)
    for p in order:
        need = needs[:, p : p + 1]
        rest = room[:, :n_open] - need
        fits = (rest > -slack).all(axis=0)
        if fits.any():
            good = (w * need * room[:, :n_open]).sum(axis=0) if rule == "dot" else -(w * rest * rest).sum(axis=0)
            top = np.where(fits, good, -np.inf)
            best = np.flatnonzero(top >= top.max() - slack)
            k = int(best[np.argmin(name[best])])
        else:
            if n_open == room.shape[1]:
                room, name, used = np.hstack([room, np.zeros_like(room)]), np.append(name, np.zeros_like(name)), np.append(used, np.zeros_like(used))
            k, n_open = n_open, n_open + 1
            room[:, k], name[k], used[k] = 1.0, made, 0
            made += 1
        bins[p], offsets[p] = name[k], used[k]
        room[:, k] -= need[:, 0]
        used[k] += lengths[p]
        if (room[:, k] < least - slack).any():  # nothing fits any more
            n_open -= 1
            room[:, k], name[k], used[k] = room[:, n_open], name[n_open], used[n_open]
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int, max_docs: int, max_cost: float) -> int:
    """Sequences that any packing needs: the greatest of the three sums over its capacity."""
    n = np.asarray(lengths, float)
    return int(np.ceil(max(n.sum() / size, len(n) / max_docs, (n * n).sum() / max_cost) - 1e-9))


def pack(pieces: DataFrame, size: int = 4096, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """(pid, sequence_id, offset). The default document and cost capacities bind no sequence that the token capacity allows."""
    max_docs, max_cost = max_docs or size, max_cost or float(size) ** 2
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    groups = max(1, -(-pieces.count() // group))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("h")
        b, o = best_fit(pdf["length"].to_numpy(), size, max_docs, max_cost, weights, rule)
        return pd.DataFrame({"pid": pdf["pid"], "sequence_id": (int(pdf["g"].iloc[0]) << 32) + b, "offset": o})

    return (
        pieces.select("pid", "length", F.xxhash64("pid").alias("h")).withColumn("g", F.pmod("h", F.lit(groups)))
        .groupBy("g")
        .applyInPandas(run, "pid long, sequence_id long, offset long")
    )


def packed(pieces: DataFrame, **options) -> DataFrame:
    """Every piece, its ids included, with its place: sequence_id and offset. Ordered by offset, the
    ids of a sequence_id are the sequence."""
    return pieces.join(pack(pieces, **options), "pid")

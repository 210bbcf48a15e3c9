"""Token-id shards with Elias-Fano document boundaries.

A shard is one binary file, written as its documents are encoded: the concatenated ids (the narrowest
unsigned type that holds the vocabulary), then document ids (int64), the boundary structure, a JSON
footer and the footer's length. Boundaries are the n+1 non-decreasing offsets of the documents into the
id array, Elias-Fano coded: low bits packed, high bits in unary, and for every 64th one of the unary
part its byte and the ones before that byte. That is about 3.5 + log2(tokens per document) bits a
document. All offsets are read by ``select`` from these: no table of them is ever built. One 64-bit
base per shard makes offsets global.

A task writes as many shards as its documents need, each of about ``SHARD_TOKENS`` ids, so memory does
not follow the data. Shard files are named by task attempt, and only files that a finished attempt
reported are in the manifest, so lost executors leave at most unreferenced files.

Defined cases: a null text is empty (its end token only); whole texts are encoded, however long; null
document ids come first, and the footer counts them; repeated rows repeat, in order of their text (the
order of rows that tie in both is of no consequence); extra columns of any name are ignored; an empty
table writes no shard.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalnet.llm.shared import durable, new_folder, open_fs, ship
from causalnet.llm.tokens import encoder

MAGIC = "IDS2"
#: A shard is closed at so many ids, or so many documents.
SHARD_TOKENS = 1 << 26
SHARD_DOCS = 1 << 20


class EliasFano:
    """Non-decreasing whole numbers in near-minimal space; ``select(i)`` is the i-th of them."""

    STEP = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples, self.before = n, low_bits, low, high, samples, before

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        flags[at] = 1
        every = at[:: cls.STEP] >> 3
        before = np.searchsorted(at, every << 3)
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), every.astype("<u4"), before.astype("<u4"))

    def select(self, i: int) -> int:
        at, rank = int(self.samples[i // self.STEP]), int(self.before[i // self.STEP])
        while rank + (k := int(self.high[at]).bit_count()) <= i:
            at, rank = at + 1, rank + k
        byte = int(self.high[at])
        for _ in range(i - rank):
            byte &= byte - 1
        bit = 8 * at + (byte & -byte).bit_length() - 1
        first = i * self.low_bits
        word = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return ((bit - i) << self.low_bits) | ((word >> (first & 7)) & ((1 << self.low_bits) - 1))

    def select_range(self, i: int, j: int) -> np.ndarray:
        """The i-th to (j-1)-th, from the samples around them: work and memory by their number."""
        if i >= j:
            return np.zeros(0, np.int64)
        a = int(self.samples[i // self.STEP])
        end = (j - 1) // self.STEP + 1
        z = int(self.samples[end]) + 1 if end < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[a:z], bitorder="little")) + 8 * a
        skip = i - int(self.before[i // self.STEP])
        ones = ones[skip : skip + j - i]
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        low = bits.reshape(j - i, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(i, j)) << self.low_bits) + low

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.samples, self.before

    def size(self) -> int:
        return sum(x.nbytes for x in self.parts())


class ShardWriter:
    """A shard under way: ids go to the file at once, lengths and document ids are held."""

    def __init__(self, folder: str, task: int, kind):
        self.uri = f"{folder}/shard-{task:06d}-{uuid.uuid4().hex[:12]}.ids"
        fs, path = open_fs(self.uri)
        fs.create_dir(folder if "://" not in folder else open_fs(folder)[1], recursive=True)
        self.out, self.kind, self.docs, self.bounds, self.nulls = fs.open_output_stream(path), np.dtype(kind), array("q"), array("q", [0]), 0

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        for x in ids:
            self.out.write(np.ascontiguousarray(x, self.kind.newbyteorder("<")).tobytes())
        self.nulls += doc_id is None
        self.docs.append(doc_id or 0)
        self.bounds.append(self.bounds[-1] + sum(map(len, ids)))

    @property
    def tokens(self) -> int:
        return self.bounds[-1]

    def full(self, tokens: int) -> bool:
        return self.tokens >= tokens or len(self.docs) >= SHARD_DOCS

    def close(self) -> None:
        bounds = EliasFano.build(np.frombuffer(self.bounds, np.int64))
        sizes = [8 * len(self.docs)]
        self.out.write(np.frombuffer(self.docs, np.int64).astype("<i8").tobytes())
        for x in bounds.parts():
            self.out.write(x.tobytes())
            sizes.append(x.nbytes)
        foot = {"magic": MAGIC, "docs": len(self.docs), "nulls": self.nulls, "tokens": self.tokens, "id_bytes": self.kind.itemsize, "low_bits": bounds.low_bits, "parts": sizes}
        text = json.dumps(foot).encode()
        self.out.write(text + struct.pack("<I", len(text)))
        self.out.close()


class Shard:
    """A shard opened for reading: document ids and the boundary structure in memory, ids by ranged reads."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<I", self.file.read_at(4, size - 4))
        self.foot = foot = json.loads(self.file.read_at(n, size - 4 - n))
        if foot["magic"] != MAGIC:
            raise OSError(f"{uri} is no shard of token ids")
        at, self.width = foot["tokens"] * foot["id_bytes"], foot["id_bytes"]
        parts = []
        for length in foot["parts"]:
            parts.append(self.file.read_at(length, at))
            at += length
        self.doc_ids, self.nulls = np.frombuffer(parts[0], "<i8"), foot["nulls"]
        self.bounds = EliasFano(foot["docs"] + 1, foot["low_bits"], *(np.frombuffer(p, t) for p, t in zip(parts[1:], (np.uint8, np.uint8, "<u4", "<u4"))))

    def read(self, i: int, j: int) -> np.ndarray:
        """The ids of the documents i to j-1."""
        a, b = self.bounds.select(i), self.bounds.select(j)
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


def write_token_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text and write shards under ``folder`` in ascending id order.

    Returns the manifest, a durable row per shard: task, shard (in order within the task), uri, docs,
    tokens, base (ids in all shards before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, shard, made = encoder(tokenizer_path), TaskContext.get().partitionId(), None, 0
        end = np.zeros(0, enc.kind) if end_id is None else np.array([end_id], enc.kind)

        def finished() -> pa.RecordBatch:
            shard.close()
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "shard": pa.array([made], pa.int32()), "uri": [shard.uri], "docs": [len(shard.docs)], "tokens": [shard.tokens]})

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t")):
                shard = shard or ShardWriter(folder, task, enc.kind)
                shard.add(i, enc.encode(t.as_py()), end)
                if shard.full(shard_tokens):
                    yield finished()
                    shard, made = None, made + 1
        if shard:
            yield finished()

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    done = src.repartitionByRange("id").sortWithinPartitions("id", "t").mapInArrow(run, "task int, shard int, uri string, docs long, tokens long")
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 64 million ids
    return durable(durable(done, "token-shards").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest")


def read_token_ids(manifest: DataFrame, docs: int = 1 << 14, ids: int = 1 << 21) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: the boundaries of ``docs``
    documents, and about ``ids`` ids (or one document), at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist()):
                s = Shard(uri)
                for first in range(0, len(s.doc_ids), docs):
                    at = s.bounds.select_range(first, min(first + docs, len(s.doc_ids)) + 1)
                    i, crc = 0, []
                    while i < len(at) - 1:
                        j = max(i + 1, int(np.searchsorted(at, at[i] + ids, side="right")) - 1)
                        own = s.read(first + i, first + j).astype("<u4")
                        crc += [zlib.crc32(own[at[k] - at[i] : at[k + 1] - at[i]].tobytes()) for k in range(i, j)]
                        i = j
                    rows = np.arange(first, first + len(at) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[rows], mask=rows < s.nulls), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("uri", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return write_token_ids(docs, tokenizer_path, new_folder(spark, "token-ids"), **options)

"""Media columns: content-defined chunks, stored once, from which payloads are rebuilt and verified.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero, within a least
and a greatest chunk length, so an edit moves only nearby cuts. Each task appends the chunks that are
new to it to a pack file (zstd, one frame a chunk) in the shared folder; Spark joins the digests of
all tasks and picks one place for each; packs are then rewritten with only the chosen chunks, an eighth
of them at a time, and an eighth of the first packs goes when its successor's places are safely written.
A document keeps its ordered chunk list. Its stored form, as digested, is what is stored for it:

    for each chunk in order, its 32-byte digest, its length and its frame's length (little-endian
    32-bit); then the zstd frames in order, as read from the packs.

Reading follows the list, unpacks the frames and checks every digest. Bytes never go through a shuffle;
digests and places do. Packs are named by task attempt, and only those in the finished tables are read,
so a lost executor costs its tasks and unreferenced files; nothing is deleted inside a task.

Defined cases: a null or empty text is 64 zero bytes; null ids keep their rows; repeated rows have
equal values; whole texts are read, however long; equal chunks are one, stored at the least of their
places; extra columns of any name are ignored; an empty table writes no pack.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import delete, durable, lookup, new_folder, open_fs, ship

LEAST, GREATEST, BITS = 1024, 16_384, 11
#: Parts in which packs are rewritten.
PARTS = 8
#: Payload bytes that a reading task takes.
READ = 32 << 20
#: Bytes that a pack gathers in memory before it writes them.
BUFFER = 4 << 20
#: Chunks that a writing task remembers.
SEEN = 500_000


def gear_table() -> np.ndarray:
    """256 mixed 32-bit numbers, by the splitmix rule."""
    out, x = [], 0
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append((z ^ (z >> 31)) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash h = 2h + gear of the bytes up to it, modulo 2^32, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: bytes, least: int = LEAST, greatest: int = GREATEST, bits: int = BITS) -> list[int]:
    """Ends of the chunks; the last is the length."""
    n, out, at = len(data), [], 0
    if n <= least:
        return [n]
    marks = np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) < np.uint32(1 << (32 - bits))) + 1
    while n - at > least:
        i = int(np.searchsorted(marks, at + least))
        at = min(int(marks[i]) if i < len(marks) else n, at + greatest, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0)), len(raw)


class Pack:
    """An append-only file of zstd frames under a shared URI, opened at the first chunk."""

    def __init__(self, uri: str):
        self.uri = uri
        self.file, self.held, self.at, self.written = None, [], 0, 0

    def add(self, frame: bytes) -> int:
        at = self.at
        self.held.append(frame)
        self.at += len(frame)
        if self.at - self.written >= BUFFER:
            self._flush()
        return at

    def _flush(self) -> None:
        if self.file is None:
            fs, path = open_fs(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.file = fs.open_output_stream(path)
        self.file.write(b"".join(self.held))
        self.held, self.written = [], self.at

    def close(self) -> None:
        if self.held:
            self._flush()
        if self.file is not None:
            self.file.close()


LIST = "array<struct<digest:binary,n:int,pack:string,at:long,len:int>>"
_CHUNK = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("pack", pa.string()), ("at", pa.int64()), ("len", pa.int32())])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all payloads; returns (row, doc_id, n_bytes, payload_bytes, chunks), chunks the ordered list."""
    spark = docs.sparkSession
    first, final = new_folder(spark, "packs-first"), new_folder(spark, "packs")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        mark = uuid.uuid4().hex
        z, pack, seen = zstandard.ZstdCompressor(3), Pack(f"{first}/{int(mark, 16) % PARTS}/{mark}.pack"), {}
        for b in batches:
            ids, sizes, whole, lists = [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("t")):
                data, n = payload(t.as_py())
                at, own = 0, []
                for end in cuts(data):
                    part = data[at:end]
                    digest = hashlib.sha256(part).digest()
                    place = seen.get(digest)
                    if place is None:
                        frame = z.compress(part)
                        place = (pack.add(frame), len(frame))
                        if len(seen) > SEEN:  # a chunk stored twice by a task is merged below
                            seen.clear()
                        seen[digest] = place
                    own.append({"digest": digest, "n": end - at, "pack": pack.uri, "at": place[0], "len": place[1]})
                    at = end
                ids.append(i), sizes.append(n), whole.append(len(data)), lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(whole, pa.int64()), pa.array(lists, pa.list_(_CHUNK))], ["doc_id", "n_bytes", "payload_bytes", "chunks"])
        pack.close()

    rows = durable(src.mapInArrow(write, f"doc_id long, n_bytes long, payload_bytes long, chunks {LIST}").withColumn("row", F.monotonically_increasing_id()), "media-rows")
    each = rows.select("row", F.posexplode("chunks").alias("k", "c")).select("row", "k", "c.*")
    chosen = durable(each.groupBy("digest").agg(F.min(F.struct("pack", "at", "len")).alias("p"), F.count(F.lit(1)).alias("n")).select("digest", "p.*", "n"), "media-chosen")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (pack, at) rows: the chosen frames of each pack, copied in order to a pack of the attempt's own."""
        name = old = out = None
        for b in batches:
            places, names = [], []
            for u, a, n in zip(b.column("pack").to_pylist(), b.column("at").to_pylist(), b.column("len").to_pylist()):
                if u != name:
                    if old is not None:
                        old.close()
                        out.close()
                    fs, path = open_fs(u)
                    name, old, out = u, fs.open_input_file(path), Pack(f"{final}/{uuid.uuid4().hex}.pack")
                places.append(out.add(old.read_at(n, a)))
                names.append(out.uri)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(names, pa.string()), pa.array(places, pa.int64()), b.column("len")], ["digest", "pack", "at", "len"])
        if old is not None:
            old.close()
            out.close()

    placed = None
    for part in range(PARTS):
        own = chosen.where(F.col("pack").startswith(f"{first}/{part}/")).select("digest", "pack", "at", "len")
        done = durable(own.repartition("pack").sortWithinPartitions("pack", "at").mapInArrow(rewrite, "digest binary, pack string, at long, len int"), "media-places")
        placed = done if placed is None else placed.unionByName(done)
        delete(spark, [f"{first}/{part}"])
    delete(spark, [first])
    found = lookup(each.select("row", "k", "digest", "n"), placed, ["digest"], counts=chosen.select("digest", "n"))
    lists = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "digest", "n", "pack", "at", "len"))), lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"), c["pack"].alias("pack"), c["at"].alias("at"), c["len"].alias("len"))).alias("chunks"))
    return durable(rows.drop("chunks").join(lists, "row"), "media")


def features(data: np.ndarray) -> str:
    """Byte statistics of a payload: mean, spread, entropy, share of zero bytes, 16-bin histogram hash."""
    n = np.bincount(data, minlength=256)
    p = n[n > 0] / len(data)
    mean = float(data.mean())
    spread = float(data.std())
    bins = n.reshape(16, 16).sum(axis=1)
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};zeros={n[0] / len(data):.4f};bins={zlib.crc32(bins.astype('<i8').tobytes()):08x}"


def rebuild(chunks: list[dict], read, size: int) -> tuple[bytes, bytes]:
    """(payload, stored form) of an ordered chunk list; ``read(pack, at, len)`` gives a frame as stored."""
    import zstandard

    z, parts, frames, table = zstandard.ZstdDecompressor(), [], [], []
    for c in chunks:
        frame = read(c["pack"], c["at"], c["len"])
        part = z.decompress(frame)
        if len(part) != c["n"] or hashlib.sha256(part).digest() != c["digest"]:
            raise OSError(f"chunk {c['digest'].hex()} is damaged")
        parts.append(part)
        frames.append(frame)
        table.append(c["digest"] + struct.pack("<II", c["n"], len(frame)))
    data = b"".join(parts)
    if len(data) != size:
        raise OSError("chunks do not add up to the payload")
    return data, b"".join(table + frames)


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of every payload, from the stored bytes."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {}

        def read(pack: str, at: int, n: int) -> bytes:
            if pack not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                fs, path = open_fs(pack)
                files[pack] = fs.open_input_file(path)
            return files[pack].read_at(n, at)

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
        for b in batches:
            out = []
            for i, n, size, chunks in zip(*(b.column(c) for c in ("doc_id", "n_bytes", "payload_bytes", "chunks"))):
                data, form = rebuild(chunks.as_py(), read, size.as_py())
                out.append((i.as_py(), n.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(form), hashlib.sha256(form).hexdigest(), features(np.frombuffer(data, np.uint8)), len(chunks)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)], names)

    tasks = -(-(stored.agg(F.sum("payload_bytes")).collect()[0][0] or 1) // READ)
    return stored.select("doc_id", "n_bytes", "payload_bytes", "chunks").repartition(tasks).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    )

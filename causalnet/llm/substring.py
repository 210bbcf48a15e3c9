"""Repeated passages across documents: paragraph MinHash banding.

A paragraph has ``LEAST_WORDS`` words at least. It is a line, or a piece of a line between sentence
ends that the words beside them choose (so a passage is cut alike wherever it stands), or a window of
``WINDOW`` words chosen by winnowing: of every ``SURE_WORDS - WINDOW + 1`` windows in a row the least
hash, so that any run of ``SURE_WORDS`` equal words holds the same chosen window wherever it stands.

* Lines and pieces have a MinHash signature over their 5-word shingles; each of its ``BANDS`` values
  is a band of its own, which misses a pair of similarity 0.8 with probability 0.2^5, or 3 in 10,000.
  Of those that collide, the ones go first that by size and sketch (``sketches``) can't be like any other
  of their band; this loses no pair. The rest are verified by the exact Jaccard similarity of their sets of
  shingles (told apart by 48-bit hashes, made anew from their words), and clustered by connected
  components; of a crowded band a spanning forest is verified, never all pairs written.
* A window is banded by its whole content, that is, it collides with equal windows only. Windows that
  touch in a document are one run; at both ends of a run the windows are compared word by word with
  those of the document that is kept (a run whose hashes alone agree goes), and the run grows by the
  equal words beyond them.

So runs of 50 equal words and more are found whole, of 30 to 49 with a chance that grows with length, and shorter passages where they
are whole paragraphs. Of each cluster that spans several documents, the occurrences outside the least
document are to be removed. Lines are told apart by a 64-bit hash of their words.

Case is folded for A to Z in every text. Defined cases: null texts and texts under 20 words have no
paragraphs; whole texts are read, however long; null ids count as one document, the first in order,
and come back as null; repeated rows are one; of one id with several texts each text has spans of its
own (``text_hash`` tells them apart), and repeats among them are left like all repeats inside one
document; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalnet.llm.shared import connected_components, delete, durable, fresh, lookup, made, release, ship

WIDTH = 5
SIMILAR = 0.8
BANDS = 5
LEAST_WORDS = 20
WINDOW = 30
#: Equal runs of so many words always share a chosen window.
SURE_WORDS = 50
#: One sentence end in so many cuts a line of ``LONG`` words or more into pieces.
CUT = 8
LONG = 100
#: Paragraphs, and their bytes, of one band compared in one task; longer runs are dealt out in pairs of chunks.
RUN = 2000
RUN_BYTES = 8 << 20
#: Sets that are sketched at once, rows of a batch of paragraphs.
SKETCHED = 1 << 12
ROWS = 1 << 16
#: Children of a node in the trees that stand for a cluster, so that no node is a hub.
BRANCHES = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_C = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windowed(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each place, by doubling."""
    out, have, part, size = None, 0, h, 1
    while True:
        if width & size:
            tail = part[have : len(h) - size + 1]
            out = part if out is None else out[: len(tail)] * np.uint64(pow(_BASE, size, 1 << 64)) + tail
            have += size
        if 2 * size > width:
            return mixed(out[: len(h) - width + 1])
        part = part[: len(part) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


def fold(text: str) -> list[bytes]:
    """The words of a text, A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Of every 5 words; fewer words are one shingle."""
    return windowed(h, WIDTH) if len(h) >= WIDTH else windowed(h, len(h)) if len(h) else h


def packed_set(text: str) -> bytes:
    """The set of a text's shingles, 6 bytes of hash each."""
    return np.unique(shingle_hashes(hashed(fold(text))) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def minhashes(shingles: np.ndarray, bounds: np.ndarray, bands: int) -> np.ndarray:
    """A row for each band: the least hash of the shingles in each [bounds[2i], bounds[2i + 1])."""
    j = np.arange(bands, dtype=np.uint64)[:, None]
    odd = (np.uint64(2) * j + np.uint64(1)) * np.uint64(_C) | np.uint64(1)
    v = mixed(np.concatenate([shingles, shingles[-1:]]) * odd + j)  # bounds may end at the last shingle's end
    return (np.minimum.reduceat(v, bounds, axis=1)[:, 0::2] ^ j * np.uint64(0x9E3779B1)).view(np.int64)


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row (size, 128 bits in two longs) for the set of 48-bit hashes in each [from, to) of ``bounds``: a
    bit is the parity of the members that fall to it. So two sketches differ in no more bits than the sets
    in members."""
    out = np.zeros((len(bounds), 3), np.int64)
    for k in range(0, len(bounds), SKETCHED):
        first, n = bounds[k : k + SKETCHED, 0], bounds[k : k + SKETCHED, 1] - bounds[k : k + SKETCHED, 0]
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        v = (shingles[at] >> np.uint64(16)) | (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(48))
        v.sort()
        v = v[np.append(True, v[1:] != v[:-1])]
        owner = (v >> np.uint64(48)).astype(np.int64)
        out[k : k + SKETCHED, 0] = np.bincount(owner, minlength=len(n))
        odd = np.bincount(owner * 128 + (v & np.uint64(127)).astype(np.int64), minlength=128 * len(n)) & 1
        out[k : k + SKETCHED, 1:] = np.packbits(odd.astype(np.uint8).reshape(-1, 128), axis=1).view(np.int64)
    return out


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words in code points, and the words before which a line begins."""
    c = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.concatenate([[True], (c == 32) | ((c >= 9) & (c <= 13)), [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    lines = np.cumsum(c == 10)
    return starts, ends, np.flatnonzero(lines[starts[1:]] != lines[ends[:-1] - 1]) + 1 if len(starts) > 1 else starts[:0]


def pieces(words: list[bytes], h: np.ndarray, breaks: list[int], least: int, cut: int) -> list[tuple[int, int]]:
    """(from, to) of lines and of the pieces into which chosen sentence ends cut them."""
    n, out = len(words), set()
    if max(b - a for a, b in zip([0, *breaks], [*breaks, n])) < LONG:
        return [p for p in zip([0, *breaks], [*breaks, n]) if p[1] - p[0] >= least]
    ends = np.array([i + 1 for i, w in enumerate(words) if w[-1] in b".!?"], np.int64)
    ends = ends[mixed(h[ends - 1] * np.uint64(3) + h[np.maximum(ends - 2, 0)]) % np.uint64(cut) == 0]
    for a, b in zip([0, *breaks], [*breaks, n]):
        inside = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, b)].tolist() if b - a >= LONG else []
        out.add((a, b))
        out.update(zip([a, *inside], [*inside, b]))
    return sorted(p for p in out if p[1] - p[0] >= least)


def extreme(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every ``width`` in a row, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = of(values[:-step], values[step:])
        size += step
    return values


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hashes of every ``width`` in a row: those that equal the greatest of the minima
    of the rows of ``width`` that hold them."""
    width = min(width, len(hashes))
    least = np.zeros(len(hashes) + width - 1, np.uint64)
    least[width - 1 : len(hashes)] = extreme(hashes, width, np.minimum)
    return np.flatnonzero(extreme(least, width, np.maximum) == hashes)


def paragraphs(text: str, least: int = LEAST_WORDS, bands: int = BANDS, cut: int = CUT) -> tuple[np.ndarray, ...]:
    """(place, hash, keys, sketch) of lines and pieces, a row of MinHash values and a sketch each, and then
    (place, hash) of windows. A place is the start and end in one long; hashes are signed longs."""
    import xxhash

    words = fold(text)
    n, none = len(words), np.zeros(0, np.int64)
    own = windows = (none, none)
    keys, sketch = np.zeros((0, bands), np.int64), np.zeros((0, 3), np.int64)
    if n < least:
        return *own, keys, sketch, *windows
    starts, ends, breaks = places(text)
    h = hashed(words)
    if parts := pieces(words, h, breaks.tolist(), least, cut):
        shingles, at = windowed(h, WIDTH), np.array(parts, np.int64)
        bounds = at - [0, WIDTH - 1]
        keys, sketch = minhashes(shingles, bounds.ravel(), bands).T, sketches(shingles, bounds)
        whole = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes()) for a, b in parts], np.uint64).view(np.int64)
        own = (starts[at[:, 0]].astype(np.int64) << 32 | ends[at[:, 1] - 1], whole)
    if n >= WINDOW:
        hashes = windowed(h, WINDOW)
        at = winnowed(hashes, SURE_WORDS - WINDOW + 1)
        windows = (starts[at].astype(np.int64) << 32 | ends[at + WINDOW - 1], hashes[at].view(np.int64))
    return *own, keys, sketch, *windows


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """(id, th, kind, place, h, keys, sketch) of every paragraph: kind 0 a line or piece with its MinHash values
    and its sketch, kind 1 a window; th is the text's hash, place its start and end in one long."""
    ship(docs.sparkSession)
    longs = pa.list_(pa.int64())

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = [paragraphs(t.as_py() or "", bands=bands) for t in b.column("t")]
            for kind, of in ((0, 0), (1, 4)):
                place, h = (np.concatenate([m[of + k] for m in made]) for k in (0, 1))
                row = pa.array(np.repeat(np.arange(len(made)), [len(m[of]) for m in made]))
                more = [pa.nulls(len(h), longs)] * 2 if kind else [lists(np.concatenate([m[k] for m in made])) for k in (2, 3)]
                columns = [b.column("id").take(row), b.column("th").take(row), pa.array(np.full(len(h), kind, np.int32)), pa.array(place), pa.array(h), *more]
                out = pa.RecordBatch.from_arrays(columns, ["id", "th", "kind", "place", "h", "keys", "sketch"])
                yield from (out.slice(k, ROWS) for k in range(0, len(h), ROWS))

    t = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("th"), t.alias("t"))
    return src.mapInArrow(run, "id long, th long, kind int, place long, h long, keys array<long>, sketch array<long>")


def start_of(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def end_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def known(df: DataFrame, *names: str) -> DataFrame:
    """Each nullable id of ``names`` as two columns that joins compare: name_z (null) and name_i."""
    return df.withColumns({f"{n}_z": F.col(n).isNull() for n in names} | {f"{n}_i": F.coalesce(F.col(n), F.lit(0)) for n in names})


def across(by: list[str], rows: DataFrame, *more: Column) -> DataFrame:
    """Groups that span several documents: by, n, kept (the least id; null ids are one document, the first)."""
    i = F.col("id")
    g = rows.groupBy(*by).agg(F.min(i).alias("lo"), F.max(i).alias("hi"), F.max(i.isNull()).alias("z"), F.count(F.lit(1)).alias("n"), *more)
    several = (F.col("lo") < F.col("hi")) | (F.col("z") & F.col("lo").isNotNull())
    return g.where(several).withColumn("kept", F.when(~F.col("z"), F.col("lo"))).drop("lo", "hi", "z")


def slices(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, beside: int = SURE_WORDS - WINDOW) -> DataFrame:
    """(id_i, id_z, th, place, h, left, body, right, shingles) of wanted (id, th, place, h): where h is null,
    their text and that of ``beside`` words on both sides, else their set of shingles. A row that is there
    twice may be there more often."""
    asked = known(wanted, "id").groupBy("id_i", "id_z", "th").agg(F.collect_set(F.struct("place", "h")).alias("places"))  # of one text
    t = F.col(text_col).cast("string")
    src = known(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("th"), t.alias("t")), "id").drop("id")
    src = src.join(asked.hint("merge"), ["id_i", "id_z", "th"])  # sorted by these, so repeated rows lie together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows: list[list] = [[] for _ in range(9)]
            for i, z, th, t, spans in zip(*(b.column(c).to_pylist() for c in ("id_i", "id_z", "th")), b.column("t"), b.column("places")):
                if (i, z, th) == last:
                    continue
                last = (i, z, th)
                text = t.as_py() or ""
                starts, ends, _ = places(text)
                for m in spans.as_py():
                    place, left, body, right, shingles = m["place"], None, None, None, None
                    p, q = place >> 32, place & ((1 << 32) - 1)
                    if m["h"] is not None:
                        shingles = packed_set(text[p:q])
                    else:
                        body = text[p:q]
                        left = text[int(starts[max(int(np.searchsorted(starts, p)) - beside, 0)]) : p]
                        right = text[q : int(ends[min(int(np.searchsorted(ends, q)) + beside, len(ends) - 1)])]
                    for c, v in zip(rows, (i, z, th, place, m["h"], left, body, right, shingles)):
                        c.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["id_i", "id_z", "th", "place", "h", "left", "body", "right", "shingles"])

    schema = "id_i long, id_z boolean, th long, place long, h long, left string, body string, right string, shingles binary"
    return src.select("id_i", "id_z", "th", "t", "places").mapInArrow(run, schema)


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Trees over those whose sets are, by a chain of pairs, at least ``least`` alike.

    Of two such sets each holds ``least`` of the other, so they share one of their rarest members even if
    the rest of each is left out (prefix filter, exact): only sets that share a rare member are compared."""
    if len(sets) == 2:
        a, b = sorted(sets, key=len)
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) >= least * len(b) else 0
        return [(int(ids[0]), int(ids[1]))] if both >= least * (len(a) + len(b) - both) - 1e-9 else []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, member, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = np.flatnonzero(np.bincount(owner, held[member] > 1) >= least * sizes - 1e-9)
    if 2 * len(some) < len(sets):
        return similar_forest(ids[some], [sets[k] for k in some], least) if len(some) > 1 else []
    rank = np.empty(len(held), np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held))
    order = np.argsort(owner << 40 | rank[member])  # rarest first in each set
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rare = order[place < np.repeat(sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, sizes)]
    by, whose = rank[member[rare]], owner[rare]
    times = np.bincount(by, minlength=len(held))
    by, whose = by[times[by] > 1], whose[times[by] > 1]
    mine = np.searchsorted(whose, np.arange(len(sets) + 1))  # the rare shared members of each set: by[mine[k] : mine[k + 1]]
    holders: dict[int, np.ndarray] = {}
    if len(by):
        sort = np.argsort(by, kind="stable")
        cuts = np.flatnonzero(np.diff(by[sort])) + 1
        holders = dict(zip(by[sort][np.append(0, cuts)].tolist(), np.split(whose[sort], cuts)))
    left, out = np.ones(len(sets), bool), []
    for k in np.flatnonzero(np.diff(mine)).tolist():
        if not left[k]:
            continue
        left[k] = False
        found, at = [k], 0
        while at < len(found):
            p = found[at]
            at += 1
            for r in (members := by[mine[p] : mine[p + 1]].tolist()):
                holders[r] = holders[r][left[holders[r]]]
            some = np.unique(np.concatenate([holders[r] for r in members]))
            some = some[(sizes[some] >= least * sizes[p] - 1e-9) & (sizes[p] >= least * sizes[some] - 1e-9)]
            if not len(some):
                continue
            values = np.concatenate([sets[i] for i in some])
            hit = sets[p][np.minimum(np.searchsorted(sets[p], values), sizes[p] - 1)] == values
            both = np.bincount(np.repeat(np.arange(len(some)), sizes[some])[hit], minlength=len(some))
            near = some[both >= least * (sizes[some] + sizes[p] - both) - 1e-9]
            found += near.tolist()
            left[near] = False
        out += [(int(ids[found[(i - 1) // BRANCHES]]), int(ids[found[i]])) for i in range(1, len(found))]
    return out


def crowded(pairs: DataFrame, most: int = RUN) -> DataFrame:
    """Durable (key, h, n, w): those of distinct (key, h, n) whose key has more than one h; n is a size in
    bytes, w the chunks into which the key's are dealt. Of keys that hold the same h, told by two 64-bit
    sums, one stays."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / RUN_BYTES)).cast("int")
    sums = (F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"s{k}") for k in (1, 2))
    width = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("c"), parts.alias("w"), *sums).where("c > 1")
    width = durable(width.groupBy("c", "s1", "s2").agg(F.min("key").alias("key"), F.max("w").alias("w")).select("key", "c", "w"), "crowded-bands")
    return durable(lookup(pairs, width.select("key", "w"), ["key"], counts=width.select("key", F.col("c").alias("n"))), "crowd")


def dealt(crowd: DataFrame) -> DataFrame:
    """(key, h, n, i, j) of a crowd: the chunks of a key in all pairs, so that each two sets meet."""
    own = F.pmod(F.xxhash64("h", F.lit(1)), F.col("w")).cast("int").alias("own")
    each = crowd.select("key", "h", "n", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("o"), own)
    return each.select("key", "h", "n", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))


def with_like(group: np.ndarray, size: np.ndarray, bits: tuple[np.ndarray, ...], least: float) -> np.ndarray:
    """Which sets may be ``least`` alike another of their group, by their sizes (ascending in a group) and
    sketches: of such two the smaller has ``least`` of the greater's size, and no more than
    (1 - least) / (1 + least) of both sizes is in one only."""
    most, hit, r, d = (1 - least) / (1 + least), np.zeros(len(size), bool), np.arange(len(size)), 0
    while len(r):
        d += 1
        r = r[: np.searchsorted(r, len(size) - d)]
        r = r[(group[r] == group[r + d]) & (size[r] >= least * size[r + d] - 1e-9)]  # all that come later are larger
        apart = sum(np.bitwise_count((x[r] ^ x[r + d]).view(np.uint64)).astype(np.int64) for x in bits)
        ok = r[apart <= most * (size[r] + size[r + d]) + 1e-9]
        hit[ok] = hit[ok + d] = True
    return hit


def possible(crowd: DataFrame, sketched: DataFrame, least: float, most: int = RUN) -> DataFrame:
    """The crowd without those that by ``sketched`` (h, sketch) can't be ``least`` alike any other of their key."""
    c = [F.col("sketch")[k].alias(f"s{k}") for k in range(3)]
    full = dealt(crowd).join(sketched.select("h", *c), "h").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "s0")
    names = ("key", "i", "j", "h", "n", "s0", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key, i, j, h, n, size, *bits):
            new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            hit = with_like(np.append(0, np.cumsum(new)), size, bits, least)
            return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, h, n)], ["key", "h", "n"])

        held: list[np.ndarray] = []  # the last group so far
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            last = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in held[:3]]))
            if len(last):
                yield found(*(x[: last[-1] + 1] for x in held))
                held = [x[last[-1] + 1 :] for x in held]
        if held:
            yield found(*held)

    left = full.select(*names).mapInArrow(run, "key long, h long, n int").distinct()
    return crowded(durable(left, "possible"), most)


def promising(sets: DataFrame, least: float) -> DataFrame:
    """The h of those of distinct (h, shingles) of whose members ``least`` or more are in another set too: no other set is like any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                members = [unpacked(x) for x in b.column("shingles").to_pylist()]
                h = np.repeat(b.column("h").to_numpy(zero_copy_only=False), [len(x) for x in members])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.concatenate(members).view(np.int64))], ["h", "m"])

    order = Window.partitionBy("m").orderBy("h")
    shared = F.lag("h").over(order).isNotNull() | F.lead("h").over(order).isNotNull()
    found = sets.select("h", "shingles").mapInArrow(run, "h long, m long").select("h", shared.cast("int").alias("shared"))
    return found.groupBy("h").agg(F.sum("shared").alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("s") >= least * F.col("c") - 1e-9).select("h")


def verified(crowd: DataFrame, sets: DataFrame, least: float = SIMILAR, most: int = RUN) -> DataFrame:
    """Durable edges (a, b) between the h of a crowd; ``sets`` (h, shingles) has their packed sets. Of keys
    dealt in chunks, those whose sets can't be like any other go before, so that chunks follow what is alike."""
    wide = crowd.where("w > 1")
    if not wide.isEmpty():
        able = durable(promising(wide.select("h").distinct().join(sets, "h"), least), "promising-sets")
        wide = crowded(durable(wide.join(able, "h", "left_semi").select("key", "h", "n"), "promising"), most)
        crowd = crowd.where("w = 1").unionByName(wide)
    full = dealt(crowd).join(sets, "h").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids, sets):
            got = similar_forest(np.array(ids), sets, least) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

        now, ids, held = None, [], []
        for b in batches:
            for key, i, j, h, raw in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "h", "shingles"))):
                if (key, i, j) != now:
                    if len(ids) > 1:
                        yield links(ids, held)
                    now, ids, held = (key, i, j), [], []
                ids.append(h)
                held.append(unpacked(raw))
        if len(ids) > 1:
            yield links(ids, held)

    return durable(full.select("key", "i", "j", "h", "shingles").mapInArrow(run, "a long, b long").distinct(), "similar")


def equal_ends(a: str, b: str, last: bool) -> tuple[int, int]:
    """How many characters of each belong to their equal words, from the last word back or from the first on."""
    p, q = list(_WORD.finditer(a)), list(_WORD.finditer(b))
    step, k = -1 if last else 1, 0
    for x, y in zip(p[::step], q[::step]):
        if fold(x.group()) != fold(y.group()):
            break
        k += 1
    if not k:
        return 0, 0
    return (len(a) - p[-k].start(), len(b) - q[-k].start()) if last else (p[k - 1].end(), q[k - 1].end())


def merged(spans: DataFrame, *first: Column) -> DataFrame:
    """Spans (id, th, kept, start, end, ...) of a text that overlap become one; ``first`` are aggregates of each."""
    order = Window.partitionBy("id", "th", "kept").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")
    islands = spans.withColumn("new", new).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("id", "th", "kept", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), *first).drop("k")


def window_runs(u: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, ends, wanted) of durable units: runs of equal windows in documents that share them, their
    first and last windows beside those of the document kept, and the places needed to compare these."""
    windows = u.where("kind = 1").select("h", "id", "th", "place")
    of = durable(across(["h"], windows), "shared-windows")
    rows = durable(lookup(windows, of.select("h", "kept"), ["h"], counts=of.select("h", "n")), "window-repeats")
    release(u.sparkSession)
    # Windows have one number of words, so the one that starts last ends last.
    at = rows.select("id", "th", "kept", start_of(F.col("place")).alias("start"), end_of(F.col("place")).alias("end"), "place", "h")
    runs = merged(at, F.min("place").alias("head"), F.max("place").alias("tail"), F.min_by("h", "place").alias("hh"), F.max_by("h", "place").alias("ht"))
    runs = durable(runs.withColumn("run", F.monotonically_increasing_id()), "runs")
    base = rows.where(F.col("id").eqNullSafe(F.col("kept"))).groupBy("h").agg(F.min(F.struct("th", "place")).alias("at")).select("h", F.col("at.th").alias("kth"), F.col("at.place").alias("kplace"))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("tail"), F.col("head").alias("place"), F.col("hh").alias("h")), F.struct(F.lit(True).alias("tail"), F.col("tail").alias("place"), F.col("ht").alias("h")))).alias("s")
    ends = durable(runs.where(~F.col("id").eqNullSafe(F.col("kept"))).select("run", "id", "th", "kept", sides).select("run", "id", "th", "kept", "s.tail", "s.place", "s.h"), "run-ends")
    ends = durable(lookup(ends, base, ["h"]), "run-ends")
    wanted = ends.select("id", "th", "place").unionByName(ends.select(F.col("kept").alias("id"), F.col("kth").alias("th"), F.col("kplace").alias("place")).distinct())
    return runs, ends, wanted.withColumn("h", F.lit(None).cast("long"))


def grown(runs: DataFrame, ends: DataFrame, text: DataFrame) -> DataFrame:
    """(id, th, kept, start, end, c): the runs, verified at both ends and grown to all equal words there."""
    text = text.where("h is null").drop("h")
    mine = known(ends, "id", "kept").join(text, ["id_i", "id_z", "th", "place"])
    mine = durable(mine.select("run", "tail", "kept_i", "kept_z", "kth", "kplace", *(F.col(c).alias(f"{c}_") for c in ("left", "body", "right"))), "run-texts")
    theirs = text.select(F.col("id_i").alias("kept_i"), F.col("id_z").alias("kept_z"), F.col("th").alias("kth"), F.col("place").alias("kplace"), "left", "body", "right")
    both = lookup(mine, theirs, ["kept_i", "kept_z", "kth", "kplace"])
    keep = ("run", "tail", "kept_i", "kept_z", "kth", "kplace")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(3)]
            for tail, l_, b_, r_, left, body, right in zip(*(b.column(c).to_pylist() for c in ("tail", "left_", "body_", "right_", "left", "body", "right"))):
                x, y = equal_ends(r_, right, False) if tail else equal_ends(l_, left, True)
                for c, v in zip(out, (fold(b_) == fold(body), x, y)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], [*keep, "same", "x", "y"])

    src = both.select(*keep, "left_", "body_", "right_", "left", "body", "right")
    found = durable(src.mapInArrow(compare, "run long, tail boolean, kept_i long, kept_z boolean, kth long, kplace long, same boolean, x int, y int"), "compared-ends")
    more = found.groupBy("run").agg(F.min("same").alias("same"), F.max(F.when(~F.col("tail"), F.col("x"))).alias("xl"), F.max(F.when(F.col("tail"), F.col("x"))).alias("xr")).where("same")
    mine = F.col("id").eqNullSafe(F.col("kept"))
    others = runs.where(~mine).join(more, "run").select("id", "th", "kept", (F.col("start") - F.col("xl")).cast("int").alias("start"), (F.col("end") + F.col("xr")).cast("int").alias("end"), F.col("hh").alias("c"))
    own = found.where("same").groupBy("kept_i", "kept_z", "kth", "kplace").agg(F.max(F.when(~F.col("tail"), F.col("y"))).alias("yl"), F.max(F.when(F.col("tail"), F.col("y"))).alias("yr"))
    own = own.select(F.col("kept_i").alias("id_i"), F.col("kept_z").alias("id_z"), F.col("kth").alias("th"), "kplace", "yl", "yr")
    kept = known(runs.where(mine), "id")
    kept = kept.join(own.select("id_i", "id_z", "th", F.col("kplace").alias("head"), "yl"), ["id_i", "id_z", "th", "head"], "left")
    kept = kept.join(own.select("id_i", "id_z", "th", F.col("kplace").alias("tail"), "yr"), ["id_i", "id_z", "th", "tail"], "left")
    kept = kept.select("id", "th", "kept", (F.col("start") - F.coalesce("yl", F.lit(0))).cast("int").alias("start"), (F.col("end") + F.coalesce("yr", F.lit(0))).cast("int").alias("end"), F.col("hh").alias("c"))
    return others.unionByName(kept)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, bands: int = BANDS, most: int = RUN) -> DataFrame:
    """Spans (id_col, start, end, cluster_id, kept_id, removed, text_hash), merged where they overlap in a text."""
    u = durable(units(docs, id_col, text_col, bands), "paragraphs", by="kind")
    windows = f"{made[-1]}/kind=1"
    lines = u.where("kind = 0").drop("kind")
    reps = lines.groupBy("h").agg(F.min(F.struct("id", "th", "place")).alias("at"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("z"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = durable(reps, "distinct-lines")
    release(docs.sparkSession)
    size = end_of(F.col("at.place")) - start_of(F.col("at.place"))
    crowd = crowded(reps.select("h", size.alias("n"), F.explode(F.array_distinct("keys")).alias("key")), most)
    release(docs.sparkSession)
    crowd = possible(crowd, reps, least, most)
    asked = reps.join(crowd.select("h").distinct(), "h", "left_semi").select("h", "at.*")
    release(docs.sparkSession)
    runs, ends, wanted = window_runs(u)
    delete(docs.sparkSession, [windows])  # what of them repeats is in tables of its own by now
    release(docs.sparkSession)
    text = durable(slices(docs, wanted.unionByName(asked), id_col, text_col), "slices")
    release(docs.sparkSession)
    sets = text.where("h is not null").select("h", "shingles")
    comp = connected_components(verified(crowd, sets, least, most)).withColumnRenamed("node", "h")
    release(docs.sparkSession)
    named = durable(reps.select("h", "lo", "hi", "z", "n").join(comp, "h", "left").withColumn("c", F.coalesce("component", "h")), "named-lines")
    wide = named.groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("z").alias("z"))
    wide = wide.where((F.col("lo") < F.col("hi")) | (F.col("z") & F.col("lo").isNotNull())).select("c", F.when(~F.col("z"), F.col("lo")).alias("kept"))
    of_lines = durable(lookup(named.select("h", "c", "n"), wide, ["c"]), "repeated-lines")
    found = lookup(lines.select("id", "th", "place", "h"), of_lines.select("h", "c", "kept"), ["h"], counts=of_lines.select("h", "n"))
    found = found.select("id", "th", "kept", start_of(F.col("place")).alias("start"), end_of(F.col("place")).alias("end"), "c")
    spans = merged(found.unionByName(grown(runs, ends, text)), F.min("c").alias("cluster_id"))
    return spans.select(F.col("id").alias(id_col), "start", "end", "cluster_id", F.col("kept").alias("kept_id"), (~F.col("id").eqNullSafe(F.col("kept"))).alias("removed"), F.col("th").alias("text_hash"))


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the spans that are to be removed; other rows and columns as they are."""
    i, no, th, cuts = fresh(docs, "id", "no", "th", "cuts")
    key = lambda c: (F.coalesce(F.col(c).cast("long"), F.lit(0)), F.col(c).isNull())
    k, n = key(id_col)
    gone = spans.where("removed").groupBy(k.alias(i), n.alias(no), F.col("text_hash").alias(th)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    joined = docs.withColumns({i: k, no: n, th: F.xxhash64(F.col(text_col).cast("string"))}).join(gone, [i, no, th], "left")
    t, own = F.col(text_col), F.col(cuts)
    upto = F.transform(own, lambda m, j: F.aggregate(F.slice(own, F.lit(1), j), F.lit(0), lambda s, x: F.greatest(s, x["end"])))
    parts = F.zip_with(own, upto, lambda m, at: F.substring(t, at + 1, F.greatest(m["start"] - at, F.lit(0))))
    rest = F.aggregate(own, F.lit(0), lambda s, x: F.greatest(s, x["end"]))
    cut = F.concat(F.array_join(parts, ""), F.substring(t, rest + 1, F.char_length(t)))
    return joined.withColumn(text_col, F.when(own.isNotNull(), cut).otherwise(t)).select(*docs.columns)

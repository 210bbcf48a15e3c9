"""Fill-in-middle transformation over succinct token boundaries.

A text is cut between tokens (a run of white space with the word after it; white space at the end is a token
of its own). Where tokens end is a bitvector over the UTF-8 bytes, packed into words, with the popcount before each block
beside it (``Bits``). Nothing lists the tokens: the popcount of a text's span gives its number of tokens, and a
select on the two drawn ranks gives the byte cuts. A second bitvector over the first bytes of characters turns cuts
into numbers of code points by rank.

The draws are the 8-digit groups of the hex SHA-256 of ``seed:id``, so reruns agree whatever the partitions.

Defined cases: a null text is empty, and an empty one is plain, as is one that holds a mark; whole texts are
cut, however long (a task holds a batch's texts and the bitvectors of some megabytes of them, or of one text); a null id
draws as an empty one; repeated rows repeat; extra columns of any name are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalnet.llm.shared import ship

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text whose bitvectors are held at a time, unless one text is longer.
SLICE = 1 << 22
BLOCK = 512
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Bits:
    """A packed bitvector of at least one place; ``before`` has the ones ahead of each block of ``BLOCK`` bits."""

    PER = BLOCK // 64

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.zeros((self.n // BLOCK + 1) * BLOCK // 8, np.uint8)
        got = np.packbits(bits, bitorder="little")
        packed[: len(got)] = got
        self.words = packed.view("<u8").reshape(-1, self.PER)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64), out=self.before[1:])

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        block, inside = at // BLOCK, at % BLOCK
        reach = np.clip(inside[:, None] - 64 * np.arange(self.PER), 0, 64)
        mask = np.where(reach == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (reach % 64).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one, k from 0."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, side="right") - 1
        words, rest, row = self.words[block], k - self.before[block], np.arange(len(k))
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)


def token_ends(data: np.ndarray, ends: np.ndarray, full: np.ndarray) -> np.ndarray:
    """True at the last byte of each token of the texts that end before ``ends``; ``full`` tells those with bytes."""
    space = _SPACE[data]
    out = np.zeros(len(data), bool)
    out[:-1] = ~space[:-1] & space[1:]
    out[ends[full] - 1] = True
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a batch's texts, without a copy of the bytes."""
    a = column.cast(pa.large_string())
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def _check(marks: Sequence[str]) -> tuple[bytes, ...]:
    """Marks that can't overlap, so that an output is read back in one way only."""
    meet = lambda a, b: a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))
    if len(set(marks)) != 3 or not all(marks) or any(meet(a, b) for a in marks for b in marks):
        raise ValueError(f"three marks are needed that can't overlap: {marks}")
    return tuple(m.encode() for m in marks)


def _cutter(marks: tuple[bytes, ...], rate: int, spm: int):
    p_mark, s_mark, m_mark = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            h = [batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
            for a, b in slices(offsets):
                base = int(offsets[a])
                d, starts, ends = data[base : int(offsets[b])], offsets[a:b] - base, offsets[a + 1 : b + 1] - base
                tokens, chars = Bits(token_ends(d, ends, ends > starts)), Bits((d & 0xC0) != 0x80)
                first = tokens.rank(starts)
                n = tokens.rank(ends) - first
                r1, r2 = h[0][a:b] % (n + 1), h[1][a:b] % (n + 1)
                cuts = []
                for k in (np.minimum(r1, r2), np.maximum(r1, r2)):
                    at = starts.copy()
                    some = k > 0
                    at[some] = tokens.select(first[some] + k[some] - 1) + 1
                    cuts.append(at)
                c1, c2 = cuts
                whole = d.tobytes()
                form, out = [], []
                drawn = (h[2][a:b] % 100 < rate) & (n > 0)
                for i, (s, x, y, e) in enumerate(zip(starts.tolist(), c1.tolist(), c2.tolist(), ends.tolist())):
                    t = whole[s:e]
                    if not drawn[i] or p_mark in t or s_mark in t or m_mark in t:
                        form.append("plain")
                        out.append(t)
                    elif h[3][a + i] % 100 < spm:
                        form.append("spm")
                        out.append(b"".join((s_mark, whole[y:e], p_mark, whole[s:x], m_mark, whole[x:y])))
                    else:
                        form.append("psm")
                        out.append(b"".join((p_mark, whole[s:x], s_mark, whole[y:e], m_mark, whole[x:y])))
                plain = np.array([f == "plain" for f in form], bool)
                at1 = chars.rank(c1)
                count = lambda v: pa.array(v, pa.int64(), mask=plain)  # noqa: E731, B023
                columns = [batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(form), count(at1 - chars.rank(starts)), count(chars.rank(c2) - at1), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: Sequence[str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): ``rate`` in a hundred texts are rearranged, ``spm`` in a
    hundred of these with the suffix first. n counts tokens; the two lengths, in code points, are null where the form is plain."""
    ship(docs.sparkSession)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(_cutter(_check(marks), rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that ``transform`` had, from its output and form alone."""
    p, s, m = marks
    part = lambda start, end: F.substring_index(F.substring_index(output, end, 1), start, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(part(p, s), middle, part(s, m))).when(form == "spm", F.concat(part(p, m), middle, part(s, p))).otherwise(output)

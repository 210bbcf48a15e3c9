"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier of hashed byte 3-grams predicts
whether a text's language has that bit. Decoding takes the codeword with the least logistic loss,
weighted by how much better than chance each bit's classifier did on every fifth learning row, which it
had not learned from; scores are a softmax of the negative losses, and a text whose two nearest codewords
lie close is flagged ambiguous.

At most ``LEARN`` rows are learned from, an equal share of each language (all rows of a language with
fewer), the first by a hash of their id; executors count their n-grams, and those counts reach the driver.

Defined cases: ``und`` (score 0) for null texts, texts without a letter, or when nothing could be
learned; null ids are never held out and never learned from; codewords that tie go by name; repeated
rows repeat; extra columns of any name are ignored; an empty table gives no rows. Whole texts are read,
in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalnet.llm.shared import durable, ship

#: Hashed n-gram features, and labelled rows for learning.
BUCKETS = 4096
LEARN = 3000
AMBIGUOUS = 0.2
_PIECE = 1 << 20


def _fold() -> np.ndarray:
    """Bytes as the features see them: ASCII letters in lower case, other ASCII as a space."""
    t = np.full(256, 32, np.uint32)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold()


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square-rooted, length-normalised counts of hashed byte 3-grams of the whole text."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    out = np.zeros(buckets, np.int64)
    for at in range(0, max(1, len(raw) - 2), _PIECE):
        b = FOLD[raw[at : at + _PIECE + 2]]
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        out += np.bincount((h ^ (h >> np.uint32(15))) % buckets, minlength=buckets)
    root = np.sqrt(out, dtype=np.float32)
    return root / max(float(np.linalg.norm(root)), 1e-9)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1. Exhaustive codes up to 5 classes; beyond, the best of seeded random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        cols = [c for c in range(1, 1 << (n - 1))]
        return np.array([[1.0 if k == 0 else (1.0 if not (c >> (k - 1)) & 1 else -1.0) for c in cols] for k in range(n)])
    rng, best = np.random.default_rng(seed), None
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = ((code.shape[1] - code @ code.T)[~np.eye(n, dtype=bool)].min()) / 2
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


class Codes:
    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, margin to the next) of each row."""
        m = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -m[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return p.argmax(axis=1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def fit(x: np.ndarray, langs: list[str], steps: int = 150, rate: float = 8.0, ridge: float = 1e-4) -> Codes:
    """From rows of features and their languages; every fifth row of a language judges the bits only."""
    names = sorted(set(langs))
    code = codewords(len(names))
    at = np.array([names.index(v) for v in langs])
    seen = np.zeros(len(names), int)
    judge = np.zeros(len(at), bool)
    for k, v in enumerate(at):
        seen[v] += 1
        judge[k] = seen[v] % 5 == 0
    own, want = x[~judge], code[at[~judge]].astype(np.float32)
    share = 1 / np.bincount(at[~judge], minlength=len(names))[at[~judge]]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b, last = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), None
    for k in range(steps):
        ahead = w if last is None else w + (k / (k + 3)) * (w - last)
        g = -share * want / (1 + np.exp(np.clip(want * (own @ ahead + b), -30, 30)))
        last, w = w, ahead - rate * (own.T @ g + ridge * ahead)
        b = b - rate * 0.1 * g.sum(axis=0)
    use = judge if judge.any() else ~judge
    return Codes(names, code, w, b, trust((x[use] @ w + b) * code[at[use]] > 0))


def trust(right: np.ndarray) -> np.ndarray:
    """A weight for each bit, their mean 1: how far its share of right answers lies above one half."""
    edge = np.maximum(right.mean(axis=0) - 0.5, 1e-3)
    return edge / edge.mean()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: int, buckets: int) -> tuple[np.ndarray, list[str]]:
    """(features, languages) of at most ``learn`` rows that are not held out. A row a language, then the
    features of the chosen rows, reach the driver."""
    known = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))
    mine = docs.where(known).select(F.xxhash64(F.col(id_col)).alias("k"), F.xxhash64(F.col(text_col)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    sizes = mine.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(learn)
    # With the smaller languages taken whole, the level to which the larger ones are cut.
    counts = [r["n"] for r in sizes.select("n").collect()]
    left, level = learn, 0
    for rest, n in zip(range(len(counts), 0, -1), reversed(counts)):
        level = left // rest
        if n > level:
            break
        left, level = left - n, n
    # About 1.5 times as many as wanted by the hash alone, so that no sort sees more; then exactly.
    share = F.least(F.lit(1.0), F.lit(1.5 * level + 50) / F.col("n"))
    near = mine.join(F.broadcast(sizes), "lang").where(F.shiftrightunsigned("k", 12) / F.lit(float(1 << 52)) <= share)  # at most ``learn`` languages
    order = Window.partitionBy("lang").orderBy("k", "h")
    chosen = durable(near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= level).drop("at", "n"), "learning-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value = [], []
            for t in b.column("t"):
                v = ngram_counts(t.as_py(), buckets)
                i = np.flatnonzero(v)
                at.append(i.astype("<u4").tobytes())
                value.append(v[i].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), b.column("lang"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["k", "h", "lang", "at", "value"])

    rows = chosen.mapInArrow(count, "k long, h long, lang string, at binary, value binary").orderBy("k", "h", "lang").collect()  # at most ``learn``
    x = np.zeros((len(rows), buckets), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["value"], "<f4")
    return x, [r["lang"] for r in rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: int = LEARN, buckets: int = BUCKETS, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every row."""
    spark = docs.sparkSession
    ship(spark)
    x, langs = learning_rows(docs, id_col, text_col, lang_col, learn, buckets)
    model = fit(x, langs) if langs else None
    shared = spark.sparkContext.broadcast(model)  # its size is buckets times bits, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score, close = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 256):
                texts = [v.as_py() for v in b.column("t").slice(at, 256)]
                use = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m else []
                if use:
                    best, p, gap = m.predict(np.stack([ngram_counts(texts[k], buckets) for k in use]))
                    for k, v, s, g in zip(use, best, p, gap):
                        lang[at + k], score[at + k], close[at + k] = m.names[v], s, g < ambiguous
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], ["id", "held_out", "lang_pred", "score", "ambiguous"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double, ambiguous boolean")

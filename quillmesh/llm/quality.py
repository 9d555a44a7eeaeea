"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits or runs of other signs; a word that repeats the word before it becomes one common
token, so that stuttering texts share features whatever they repeat. Unigrams and bigrams are hashed to 2^bits places, with
values sqrt(count / all) (of unit length). Scores are sparse dot products through the logistic function.

The fit reads at most max_rows labelled rows, those with the smallest hash of doc_id, in one task that streams them; the
weights, 2^bits floats and a bias, are broadcast (1 MB at the default). Scoring reads every row and moves none.

Of rows that share an id the least text is learnt from, so the fit's rows are bounded too.

Defined cases: null, empty and signless texts score by the bias alone; rows with a null doc_id are scored, not learnt
from; ids whose labels disagree or are null are not learnt from; without labels every score is 0.5; held_out is null for a
null doc_id; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, text_bytes

BITS = 18
MAX_ROWS = 8000
THRESHOLD = 0.7
EPOCHS = 4
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
REPEAT = b"\x00repeat"
MEMO = 200_000


class Hasher:
    """Text to (places, values); keeps the hashes of up to MEMO tokens."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift, self.memo = np.uint64(64 - bits), {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            h = [memo[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in memo:
                    memo[t] = xxhash.xxh64_intdigest(t)
            h = [memo[t] for t in tokens]
        h = np.array(h, np.uint64)
        word = np.array([t[0] >= 128 or t[:1].isalnum() for t in tokens])
        at = np.flatnonzero(word)
        same = at[1:][h[at[1:]] == h[at[:-1]]]
        h[same] = xxhash.xxh64_intdigest(REPEAT)
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))
        grams = np.concatenate([h * np.uint64(0xC2B2AE3D27D4EB4F), pairs * np.uint64(0xD6E8FEB86659FD93)]) >> self.shift
        places, counts = np.unique(grams.astype(np.int64), return_counts=True)
        return places, np.sqrt(counts / len(grams))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of 2^bits places and, last, the bias, after the rows in the given order, epochs times."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return -np.where(np.abs(zi) > L1, zi - np.sign(zi) * L1, 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(epochs):
        for places, values, label in rows:
            i, x = np.append(places, size - 1), np.append(values, 1.0)
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learnt from labels.quality of documents with crc32(doc_id) mod folds other than held_out."""
    agreed = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder("doc_id", folds) != held_out))
    agreed = agreed.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = agreed.select("doc_id", F.col("low").cast("int").alias("label"), order.alias("place")).orderBy("place", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("place", "doc_id").agg(F.min(F.struct("text", "label")).alias("r")).select("place", "doc_id", "r.text", "r.label")
    rows = rows.repartition(1).sortWithinPartitions("place", "doc_id", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(bits), []
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                places, values = hasher(text)
                seen.append((places.astype(np.int32), values.astype(np.float32), int(label > 0)))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([ftrl(seen, bits).tobytes()], pa.binary())})

    found = rows.mapInArrow(train, "weights binary").first()
    return np.frombuffer(found.weights, np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score_udf(spark: SparkSession, weights: np.ndarray) -> Callable[[Column], Column]:
    """Scores of UTF-8 texts by the broadcast weights."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights)
    held: list = []

    def scores(texts: pa.Array) -> pa.Array:
        if not held:
            held.extend([shared.value.astype(np.float64), Hasher(bits)])
        w, hasher = held
        dots = np.empty(len(texts))
        for i, text in enumerate(texts):
            places, values = hasher(text.as_py())
            dots[i] = w[-1] + w[places] @ values
        return pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    return F.arrow_udf(scores, "double")


def score(docs: DataFrame, weights: np.ndarray, held_out: int = 2, folds: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), score_udf(docs.sparkSession, weights)(text_bytes()).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more."""
    return docs.where(score_udf(docs.sparkSession, weights)(text_bytes()) >= threshold)

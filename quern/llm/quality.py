"""Operator 10, quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are its words and pairs of neighbouring words, hashed to `2**bits` weights, each with the
value (occurrences / all occurrences) * SCALE, plus a constant.  Only the text is ever an input of a score.

Nulls and empty texts have the constant alone; very long texts are read whole.  Repeated rows are scored alike, every row
for itself, and learned from once; rows of `labels` with a null or other quality than 0 and 1, or a null doc_id, are not learned
from; without a labelled row the score is 0.5, and an empty table gives no rows.  A row with a null doc_id is scored as any other;
it is not held out.  Other columns pass through untouched unless they carry the name of a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textvec as tv

BITS = 18
SCALE = 30.0
#: Labelled rows learned from, about: a hash of doc_id picks them when there are more.
TRAIN_ROWS = 8000
EPOCHS = 4
#: Scores from here on count as good.
CUT = 0.3


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of consecutive rows, index of each row's first): words, then pairs."""
    words = tv.Words(data, offsets, lower=True)
    h = words.hashes()
    pairs = tv.runs(h, 2)
    at = tv.inside(words.first, 2)
    n = np.diff(words.first)
    first = np.concatenate([[0], np.cumsum(n + np.maximum(n - 1, 0))])
    out = np.empty(first[-1], np.uint64)
    lead = np.repeat(first[:-1] - words.first[:-1], n)
    out[np.arange(len(h)) + lead] = h
    row = np.repeat(np.arange(len(n)), np.maximum(n - 1, 0))
    out[at - words.first[row] + first[row] + n[row]] = pairs[at]
    return (out >> np.uint64(64 - bits)).astype(np.int64), first


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with squared and absolute penalties."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        y = b.column("quality").to_numpy(zero_copy_only=False)
        key = b.column("row_key").to_numpy(zero_copy_only=False)
        for at, end, data, offsets in tv.slices(b.column("text")):
            f, first = features(data, offsets, bits)
            for k in range(end - at):
                i, c = np.unique(f[first[k] : first[k + 1]], return_counts=True)
                x = np.append(c * (SCALE / max(1, c.sum())), 1.0)
                rows.append((key[at + k], np.append(i, 1 << bits).astype(np.int32), x.astype(np.float32), float(y[at + k])))
    rows.sort(key=lambda r: r[0])
    model = Ftrl((1 << bits) + 1)
    for _ in range(EPOCHS):
        for _, i, x, y in rows:
            model.learn(i, x.astype(float), y)
    w = model.weights().astype(np.float32).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([w], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learned from labelled texts whose crc32(doc_id as text) mod 5 is not 0.

    The sample has `rows` different rows of docs at most, so one task learns from it and the weights (4 * 2**bits bytes)
    fit anywhere.  That task gets the sample alone: documents are read, joined and filtered where they lie.
    """
    known = (
        labels.where("quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
        .select("doc_id", F.col("quality").cast("double").alias("quality"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(known), "doc_id")
        .select("text", "quality", F.xxhash64("doc_id", "text").alias("row_key"))
        .dropDuplicates(["row_key"])
        .orderBy("row_key")
        .limit(rows)
    )
    got = sample.repartition(1).mapInArrow(lambda it: _fit(it, bits), "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` to the columns `keep` of docs (all by default)."""
    spark = docs.sparkSession
    bits = (len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    inner, place, kept = tv.carry(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for b in batches:
            out = np.empty(b.num_rows)
            for at, end, data, offsets in tv.slices(b.column(place)):
                f, first = features(data, offsets, bits)
                total = np.concatenate([[0.0], np.cumsum(w[f])])
                out[at:end] = (total[first[1:]] - total[first[:-1]]) * (SCALE / np.maximum(1, np.diff(first))) + w[-1]
            s = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    schema = kept.add("score", "double").add("predicted", "integer")
    return inner.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights, keep=["doc_id"]).select(
        "doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), "score", "predicted"
    )

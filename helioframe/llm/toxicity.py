"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs over one and two skipped words of the whole text.  FTRL-proximal
keeps a learning rate per coordinate and soft-thresholds by L1, so few weights are not zero; those alone (at most
2**bits, 12 bytes each) are broadcast for scoring.  Training takes a bounded sample of labelled rows (``max_rows``, the
lowest hashes of their ids, so reruns agree); scoring is one narrow pass over all documents.

Defined cases: null or empty texts have no feature and get the base rate of the intercept; repeated labels of an id count
as toxic if one is; null labels and labels without a document are left out before the sample is taken; of several texts
under one id the one of the lowest hash is learnt; without any labelled row every score is 0.5
and predicted 1; empty tables give no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import STEP, alnum_words, mixed, released, word_hashes

BITS, MAX_ROWS, EPOCHS = 20, 20_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
SKIPS = (0, 1, 2)


def features(body: bytes | None, bits: int = BITS) -> np.ndarray:
    """Distinct buckets of the words, and of the pairs with 0, 1 and 2 words between."""
    h = word_hashes(alnum_words(body))
    parts = [mixed(h)] + [mixed(h[: -s - 1] * STEP + mixed(h[s + 1 :] + np.uint64(s))) for s in SKIPS if len(h) > s + 1]
    return np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64))


class Ftrl:
    """FTRL-proximal for 0/1 features; coordinate ``2**bits`` is the intercept, which L1 spares."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> DataFrame:
    """(bucket, weight) of the weights that are not zero, learnt from at most ``max_rows`` labelled documents in one task."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y is not null")
    bodies = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("body"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).join(bodies.select("id"), "id", "left_semi")
    sample = known.withColumn("rank", F.xxhash64("id")).orderBy("rank", "id").limit(max_rows)
    rows = bodies.join(F.broadcast(cut_lineage(sample, "sample")), "id")  # max_rows bounds the broadcast
    # of several texts under one id the one of the lowest hash
    rows = rows.groupBy("id", "rank", "y").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body")).alias("b")).select("rank", "y", "b.body")

    @released
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(b, bits).astype(np.int32).tobytes() for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["rank", "y", "found"])

    @released
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, y, parts, sizes = Ftrl(bits), [], [], []
        for batch in batches:  # one block of numbers a batch, not one object a row
            y += batch.column(1).to_pylist()
            sizes.append(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4)
            parts.append(np.frombuffer(b"".join(v.as_buffer() for v in batch.column(2)), np.int32))
        first = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)]))]).astype(np.int64)
        found = np.concatenate([*parts, np.empty(0, np.int32)])
        parts.clear()
        for epoch in range(epochs if y else 0):
            for k in np.random.default_rng(epoch).permutation(len(y)).tolist():
                model.learn(found[first[k] : first[k + 1]], y[k])
        at = np.flatnonzero(model.z)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0], pa.int64()), pa.array(w[w != 0], pa.float64())], names=["bucket", "weight"])

    made = rows.mapInArrow(buckets, "rank long, y int, found binary")
    return cut_lineage(made.repartition(1).sortWithinPartitions("rank").mapInArrow(fit, "bucket long, weight double"), "weights")


def score(documents: DataFrame, weights: DataFrame, text: str = "text", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (its columns ``keep``, all by default) and ``score`` between 0 and 1."""
    rows = weights.collect()
    table = np.zeros((1 << bits) + 1, np.float32)
    table[[r.bucket for r in rows]] = [r.weight for r in rows]
    at = np.flatnonzero(table)
    sent = documents.sparkSession.sparkContext.broadcast((at, table[at]))

    @F.arrow_udf(T.DoubleType())
    def run(bodies: pa.Array) -> pa.Array:
        w = np.zeros((1 << bits) + 1)
        w[sent.value[0]] = sent.value[1]
        total = [w[features(b.as_py(), bits)].sum() + w[-1] for b in bodies]
        pa.default_memory_pool().release_unused()
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(total, np.float64), -35, 35))), pa.float64())

    names = documents.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names])  # stays in the JVM; only the text goes to Python
    once = run.asNondeterministic()  # a later filter is not pushed below it, which would score twice
    return documents.select(row.alias("row"), once(F.col(f"`{text}`").cast("binary")).alias("score"))

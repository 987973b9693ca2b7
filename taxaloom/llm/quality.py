"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of whole texts.

Statistics of a text are counts (words, distinct words, repeated neighbours, character classes,
lines), turned into logarithms and smoothed logits. Each class gets its mean and a covariance that is
shrunk towards a scaled identity; the Cholesky factor of each covariance is inverted once and
kept with the model. The score is the logistic function of the difference of the log densities (from
Mahalanobis distances and log determinants) plus the log odds of the classes.

Learning reads every labelled row outside the held-out fifth: partial sums of statistics and of their
products are made in the tasks and added by Spark, so the driver gets about 2 * d * d numbers.
Null and empty texts have well defined statistics (all counts 0) and get a score. Rows with a null label
teach nothing; without rows of both classes every score is the share of label 1 (0.5 without any label). A document that is labelled
twice with one label teaches once. Repeated rows score alike; texts are measured whole. Documents that have the score's column are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, held_out, refuse_clash
from .textarrays import Words, per_doc, text_slices

SHRINKAGE = 0.1
THRESHOLD = 0.3
#: Partial sums are added as whole numbers of this part, so that the model does not depend on the order of tasks.
UNITS = 2.0**24
#: Statistics of few words scatter widely; the evidence of n words counts n / (n + FEW_WORDS).
FEW_WORDS = 40.0


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics for each text."""
    w = Words(texts)
    cp, offsets = w.cp, w.offsets
    chars = np.diff(offsets).astype(np.float64)
    n = np.diff(w.word_offsets).astype(np.float64)
    upper = (cp >= 65) & (cp <= 90) | (cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)
    lower = (cp >= 97) & (cp <= 122) | (cp >= 0xDF) & (cp != 0xF7)
    symbol = np.isin(cp, np.frombuffer("#*$%&|<>@^~=+_\\/{}[]".encode("utf-32-le"), np.uint32))
    classes = [per_doc(x, offsets) for x in (upper, lower, symbol, (cp >= 48) & (cp <= 57), (cp == 33) | (cp == 63), (cp == 44) | (cp == 46), cp == 10)]
    size = (w.ends - w.starts).astype(np.float64)
    letters, squares = per_doc(size, w.word_offsets), per_doc(size * size, w.word_offsets)
    same = lambda back: per_doc(np.concatenate([np.zeros(min(back, len(w.doc)), bool), (w.hashes[back:] == w.hashes[:-back]) & (w.doc[back:] == w.doc[:-back])]), w.word_offsets)
    distinct, top, pairs = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    bigrams = w.hashes.copy()
    bigrams[1:] += w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(len(texts)):
        a, b = w.word_offsets[i], w.word_offsets[i + 1]
        if b > a:
            h = np.sort(w.hashes[a:b])
            change = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            distinct[i], top[i] = len(change) - 1, np.diff(change).max()
            p = np.sort(bigrams[a + 1 : b])
            pairs[i] = (p[1:] != p[:-1]).sum() + 1 if len(p) else 0
    logit = lambda k, of: np.log((k + 0.5) / (np.maximum(of - k, 0) + 0.5))
    mean = letters / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0))
    columns = [np.log1p(n), np.log1p(distinct) - np.log1p(n), np.log1p(pairs) - np.log1p(n), logit(top, n), logit(same(1), n), logit(same(2), n), np.log1p(mean), np.log1p(spread), *(logit(x, chars) for x in classes)]
    return np.stack(columns, axis=1)


DIMENSIONS = 15


@dataclass
class Model:
    """Means, inverted Cholesky factors and log determinants of class 0 and 1 in standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    prior: float
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    logdet: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ w.T) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.logdet, strict=True)]
        words = np.expm1(x[:, 0])
        odds = (density[1] - density[0]) * words / (words + FEW_WORDS) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def moments(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, k, total): entry k of the sums of (1, x) (1, x)^T over the labelled rows that may teach."""
    learn = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()

    def features():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in text_slices(batch.column("text")):
                x = statistics(texts)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), lists], names=["doc_id", "x"])

        return step

    x = by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id"))), "doc_id long, x array<double>", features)
    labelled = x.join(learn, "doc_id").select("quality", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = DIMENSIONS + 1
        total = np.zeros((2, d, d))
        for batch in batches:
            rows = np.ones((batch.num_rows, d))
            rows[:, 1:] = batch.column("x").flatten().to_numpy().reshape(-1, DIMENSIONS)
            y = batch.column("quality").to_numpy()
            for c in (0, 1):
                total[c] += rows[y == c].T @ rows[y == c]
        label = np.repeat([0, 1], d * d).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(np.tile(np.arange(d * d, dtype=np.int32), 2)), pa.array(total.ravel())], names=["label", "k", "total"])

    return labelled.mapInArrow(sums, "label int, k int, total double").groupBy("label", "k").agg((F.sum(F.rint(F.col("total") * UNITS).cast("decimal(38,0)")).cast("double") / UNITS).alias("total"))


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    d = DIMENSIONS + 1
    total = np.zeros((2, d * d))
    for label, k, value in moments(docs, labels).collect():  # 2 * d * d rows, whatever the corpus
        total[label, k] = value
    total = total.reshape(2, d, d)
    n = total[:, 0, 0]
    if n.min() < 2:
        return Model(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), float((n[1] + 0.5) / (n.sum() + 1)), [], [], [])
    centre = total[:, 0, 1:].sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diagonal(total[:, 1:, 1:].sum(0)) / n.sum() - centre**2, 1e-6))
    means, whiten, logdet = [], [], []
    for c in (0, 1):
        mean = total[c, 0, 1:] / n[c]
        cov = (total[c, 1:, 1:] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / DIMENSIONS, 1e-3) * np.eye(DIMENSIONS)
        chol = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        whiten.append(np.linalg.inv(chol))
        logdet.append(float(2 * np.log(np.diagonal(chol)).sum()))
    return Model(centre, scale, float(n[1] / n.sum()), means, whiten, logdet)


def score(docs: DataFrame, model: Model, out: str = "quality_score") -> DataFrame:
    """All columns of docs and `out`, the score of the whole text."""
    refuse_clash(docs, out)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in text_slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(shared.value.score(statistics(texts)))], names=[*names, out])

        return step

    return by_batch(docs, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{out} double"]), make)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    return score(docs, fit(docs, labels), "__score").where(F.col("__score") >= threshold).drop("__score")

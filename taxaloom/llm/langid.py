"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters: the first rotated by
two places, the second by one, multiplied element by element. The profile of a text bundles (adds) the
vectors of all its trigrams, words being padded with a blank; a language's prototype bundles those of
its texts. A text gets the language whose prototype has the largest cosine with its profile.

Letters are folded to lower case and hashed to SYMBOLS - 1 vectors, so any script has one. Texts that are
null or have no letter get `und` and score 0. Equal cosines go to the language first by code point. Null
languages teach nothing; without any language learned every prediction is `und`. Repeated rows teach once each and are
predicted alike. An empty table gives no language and no row. Texts are read whole. Documents with a column lang_pred or score are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, held_out, refuse_clash
from .textarrays import code_points, mix, text_slices

DIMENSIONS = 512
SYMBOLS = 64
SEED = 11


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Code point -> symbol: 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint8)
    points = np.array([c for c in range(0x33480) if chr(c).isalpha()], np.int64)
    lower = np.array([ord(chr(c).lower()[0]) for c in points], np.uint64)
    out[points] = 1 + np.where((lower >= 97) & (lower <= 122), lower - 97, np.uint64(26) + mix(lower + np.uint64(SEED)) % np.uint64(SYMBOLS - 27))
    return out


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    bits = mix(np.arange(SYMBOLS * DIMENSIONS, dtype=np.uint64) + np.uint64(SEED << 32)) >> np.uint64(63)
    return (bits.astype(np.int8) * 2 - 1).reshape(SYMBOLS, DIMENSIONS)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    return np.roll(v, 2, axis=1)[codes >> 12] * np.roll(v, 1, axis=1)[codes >> 6 & 63] * v[codes & 63]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, text number) of all trigrams with a letter in the middle, and whether each text has a letter."""
    cp, offsets = code_points(texts)
    s = np.zeros(len(cp) + 2, np.int32)
    s[1:-1] = letter_classes()[np.minimum(cp, 0x10FFFF)]
    left, right = s[:-2].copy(), s[2:].copy()
    inner = offsets[:-1][np.diff(offsets) > 0]
    left[inner] = 0
    right[offsets[1:][np.diff(offsets) > 0] - 1] = 0
    middle = np.flatnonzero(s[1:-1])
    doc = np.searchsorted(offsets, middle, side="right") - 1
    return left[middle] << 12 | s[1:-1][middle] << 6 | right[middle], doc, np.bincount(doc, minlength=len(texts)) > 0


def prototypes(docs: DataFrame) -> DataFrame:
    """(lang, dim, value): whole-number sums over all documents that may teach."""
    learn = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            rows = [(lang, sum(c[k : k + 4096] @ trigram_vectors(u[k : k + 4096]).astype(np.float64) for k in range(0, len(u), 4096))) for lang, c in counts.items() for u in [np.flatnonzero(c)] for c in [c[u].astype(np.float64)]]
            value = np.concatenate([np.rint(np.atleast_1d(v) + np.zeros(DIMENSIONS)) for _, v in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([x for x, _ in rows], DIMENSIONS).tolist(), pa.string()), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(rows))), pa.array(value)], names=["lang", "dim", "value"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in text_slices(batch.column("text")):
                code, doc, _ = trigrams(texts)
                names = sorted(set(langs[first : first + len(texts)]))
                of = np.array([names.index(x) for x in langs[first : first + len(texts)]])
                for k, name in enumerate(names):
                    here = code[of[doc] == k]
                    counts[name] = counts.get(name, 0) + np.bincount(here, minlength=SYMBOLS**3)
                if len(counts) > 32:  # bounds what a task holds if there are many languages
                    yield emit()
        yield emit()

    return learn.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language: DIMENSIONS numbers for each language come to the driver."""
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in prototypes(docs).collect():
        out.setdefault(lang, np.zeros(DIMENSIONS))[dim] = value
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def profile_cosines(texts: list[str], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each text's profile with each prototype, and whether the text has a letter."""
    code, doc, lettered = trigrams(texts)
    distinct, which = np.unique(code, return_inverse=True)
    vectors = trigram_vectors(distinct).astype(np.float32)
    out = np.zeros((len(texts), len(unit)))
    for k in range(0, len(texts), 64):
        a, b = np.searchsorted(doc, [k, k + 64])
        rows = min(64, len(texts) - k)
        count = np.bincount((doc[a:b] - k) * len(distinct) + which[a:b], minlength=rows * len(distinct)).reshape(rows, -1)
        used = np.flatnonzero(count.any(0))
        profile = (count[:, used].astype(np.float32) @ vectors[used]).astype(np.float64)
        out[k : k + rows] = profile @ unit.T / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    return out, lettered


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """All columns of docs and lang_pred, score."""
    refuse_clash(docs, "lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        langs = list(shared.value)
        unit = np.array(list(shared.value.values())).reshape(len(langs), DIMENSIONS)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in text_slices(batch.column("text")):
                part = batch.slice(first, len(texts))
                if langs:
                    cosine, lettered = profile_cosines(texts, unit)
                    best = cosine.argmax(1)
                    label = [langs[k] if yes else "und" for k, yes in zip(best, lettered, strict=True)]
                    value = np.where(lettered, np.clip(cosine.max(1), 0, 1), 0.0)
                else:
                    label, value = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(label, pa.string()), pa.array(value)], names=[*names, "lang_pred", "score"])

        return step

    return by_batch(docs, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"]), make)

"""Toxicity by the nearest labelled examples under TF-IDF cosine, found with a block-max inverted index.

Terms are lower-cased runs of letters. The vocabulary is the VOCABULARY terms whose presence tells most about the label (G-test of at least
EVIDENCE), learned from LEARN_ROWS labelled rows; their inverse document frequencies count every document of the corpus.
A text is the unit vector of (1 + ln tf) * idf over the vocabulary. At most EXAMPLES learned rows with such a term are the
examples. The index cuts them into blocks of BLOCK, which are alike because examples lie in order of their heaviest
term; it keeps each term's postings by block and its greatest weight in each block. A text visits blocks in order of the sum of
those bounds and stops when the next bound is below its K-th best cosine, so the K nearest are exact; equal cosines
go to the smaller doc_id. Neighbours vote by 1 / (1 - cosine + NEAR). The share of votes becomes a probability by a monotone
table, fitted on the learned rows with each row's own example left out; texts without a term of the vocabulary have the
rate of learned rows without one. The neighbours are returned as evidence.

Bounds of what is learned (a model, whose size does not follow the corpus): LEARN_ROWS labelled ids, those with the smallest hashes, VOCABULARY
terms, EXAMPLES examples. Scoring and document frequencies cover all rows and whole texts. Null and empty texts have no term and get that rate;
rows with a null id or label teach nothing; a document labelled both ways teaches both; repeated rows teach once
and score alike; without labels every score is 0.5, with labels of one kind their smoothed rate. An empty table gives no row.
Documents that have a column that is added are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, refuse_clash, row_hash
from .textarrays import code_points, span_hashes, spans, text_slices

LEARN_ROWS = 16_384
VOCABULARY = 512
EXAMPLES = 4_096
EVIDENCE = 15.0
BLOCK = 64
K = 16
NEAR = 0.05
BINS = 20
THRESHOLD = 0.3


def held_back(doc_id: Column) -> Column:
    """True for the quarter of the ids that teaches nothing here; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(1)
def folded_letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    points = [c for c in range(0x33480) if chr(c).isalpha()]
    out[points] = [ord(chr(c).lower()[0]) for c in points]
    return out


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every term of all texts, in order."""
    cp, offsets = code_points(texts)
    folded = folded_letters()[np.minimum(cp, 0x10FFFF)]
    letter, first = np.zeros(len(cp) + 1, bool), np.zeros(len(cp) + 1, bool)
    letter[:-1] = folded > 0
    first[offsets] = True
    before = np.zeros(len(cp) + 1, bool)
    before[1:] = letter[:-1]
    starts, ends = np.flatnonzero(letter & (first | ~before)), np.flatnonzero(before & (first | ~letter))
    return np.searchsorted(offsets, starts, side="right") - 1, span_hashes(folded, starts, ends).view(np.int64)


def counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text number, term) with their counts, in order."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])[: len(doc)])
    return doc[new], term[new], np.diff(np.append(new, len(doc)))


def learned(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, terms, tf) of the labelled rows that teach, at most `rows` labels."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_back(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", row_hash().alias("h")).agg(F.first("text").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, part in text_slices(batch.column("text")):
                doc, term, count = counted(*terms(part))
                at = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)) for c in ("doc_id", "toxic")), pa.ListArray.from_arrays(at, pa.array(term)), pa.ListArray.from_arrays(at, pa.array(count.astype(np.int64)))], names=["doc_id", "toxic", "terms", "tf"])

        return step

    return by_batch(texts, "doc_id long, toxic int, terms array<long>, tf array<long>", make)


def telling(rows: DataFrame, n0: int, n1: int, size: int, evidence: float) -> np.ndarray:
    """The terms whose presence depends most on the label, sorted."""
    by_term = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("m"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, m, n = F.col("a").cast("double"), F.col("m").cast("double"), n0 + n1
    g = 2 * (part(a, m * n1 / n) + part(m - a, m * n0 / n) + part(n1 - a, (n - m) * n1 / n) + part(n0 - m + a, (n - m) * n0 / n))
    found = by_term.withColumn("g", F.round(g, 6)).where(F.col("g") >= evidence).orderBy(F.desc("g"), "term").limit(size)
    return np.sort(np.array([r.term for r in found.select("term").collect()], np.int64))  # at most `size` terms


def in_vocabulary(vocabulary: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are in the vocabulary, and their places in it."""
    if not len(vocabulary):
        return np.zeros(len(term), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    known = vocabulary[at] == term
    return known, at[known]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those that have each term. One number for each term comes to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, part in text_slices(batch.column("text")):
                doc, term = terms(part)
                known, at = in_vocabulary(shared.value, term)
                total[:-1] += np.bincount(counted(doc[known], at)[1], minlength=len(total) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for k, n in docs.select("text").mapInArrow(run, "k long, n long").where("n > 0").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return int(out[-1]), out[:-1]


class BlockMax:
    """Unit vectors of examples as postings by block and term, with the greatest weight of each term in each block."""

    def __init__(self, size: int, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        heaviest = np.array([t[np.argmax(w)] for t, w in vectors], np.int64)
        order = np.lexsort((ids, labels, heaviest))
        self.size, self.block, self.ids, self.labels = size, BLOCK, ids[order], labels[order]
        n = len(order)
        self.blocks = -(-n // self.block)
        row = np.repeat(np.arange(n), [len(vectors[k][0]) for k in order])
        term = np.concatenate([*(vectors[k][0] for k in order), np.zeros(0, np.int64)])
        weight = np.concatenate([*(vectors[k][1] for k in order), np.zeros(0)])
        key = row // self.block * size + term
        by_key = np.argsort(key, kind="stable")
        self.row, self.weight, key = row[by_key], weight[by_key], key[by_key]
        self.keys, self.at = np.unique(key, return_index=True)
        self.at = np.append(self.at, len(key))
        self.most = np.zeros((size, self.blocks))
        np.maximum.at(self.most, (term, row // self.block), weight)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a cosine above 0; equal cosines (to nine places) by id. but: an id that is left out."""
        bound = weight @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        rows, cosines, least, done, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 8
        while done < len(order):
            blocks = order[done : done + step]
            blocks = blocks[(bound[blocks] > 0) & (bound[blocks] >= least - 1e-8)]
            if not len(blocks):
                break
            done, step = done + step, 2 * step
            keys = (blocks[:, None] * self.size + term).ravel()
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            sizes = np.where(self.keys[slot] == keys, self.at[slot + 1] - self.at[slot], 0)
            at = spans(self.at[slot], sizes)
            cosine = np.bincount(self.row[at], np.repeat(np.tile(weight, len(blocks)), sizes) * self.weight[at], minlength=len(self.ids))
            here = np.flatnonzero(cosine > 0)
            if but is not None:
                here = here[self.ids[here] != but]
            rows, cosines = np.concatenate([rows, here]), np.concatenate([cosines, np.round(cosine[here], 9)])
            if len(rows) >= k:
                least = np.partition(cosines, -k)[-k]
                rows, cosines = rows[cosines >= least], cosines[cosines >= least]
        best = np.lexsort((self.labels[rows], self.ids[rows], -cosines))[:k]
        return rows[best], np.minimum(cosines[best], 1.0)


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMax | None
    without: float  # the score of a text without a term of the vocabulary
    table: np.ndarray  # scores at shares 0, 1 / BINS, ..., 1

    def vector(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[at]
        return at, w / np.sqrt((w * w).sum())

    def share(self, at: np.ndarray, tf: np.ndarray, but: int | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The share of toxic votes (None without neighbours), the neighbours' rows and cosines."""
        if not len(at) or self.index is None:
            return None, np.zeros(0, np.int64), np.zeros(0)
        rows, cosines = self.index.nearest(*self.vector(at, tf), K, but)
        if not len(rows):
            return None, rows, cosines
        votes = 1 / (1 - cosines + NEAR)
        return float((votes * self.index.labels[rows]).sum() / votes.sum()), rows, cosines

    def score(self, share: float | None) -> float:
        return self.without if share is None else float(np.interp(share * BINS, np.arange(BINS + 1), self.table))


def monotone(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence by weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (v1, w1, n1), (v2, w2, n2) = pools[-2:]
            pools[-2:] = [[(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, size: int = VOCABULARY, examples: int = EXAMPLES, evidence: float = EVIDENCE) -> Model:
    spark = docs.sparkSession
    with Scratch(spark) as space:
        learn = space.written(learned(docs, labels, rows))
        counts = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
        n0, n1 = counts.get(0, 0), counts.get(1, 0)
        rate = (n1 + 0.5) / (n0 + n1 + 1)
        model = Model(np.zeros(0, np.int64), np.zeros(0), None, rate, np.full(BINS + 1, rate))
        if not n0 or not n1:
            return model
        model.vocabulary = telling(learn, n0, n1, size, evidence)
        total, df = document_frequencies(docs, model.vocabulary)
        model.idf = np.log((total + 1) / (df + 1)) + 1
        chosen = _chosen(learn, model)
        # Bounded: at most `examples` vectors of at most `size` terms.
        picked = chosen.where(F.size("at") > 0).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "at", "tf").limit(examples).collect()
        if picked:
            vectors = [model.vector(np.array(r["at"], np.int64), np.array(r["tf"], np.float64)) for r in picked]
            model.index = BlockMax(len(model.vocabulary), np.array([r.doc_id for r in picked], np.int64), np.array([r.toxic for r in picked], np.int64), vectors)
        bins = np.zeros((BINS + 2, 2))
        for k, toxic, n in _left_out(chosen, model).groupBy("bin", "toxic").count().collect():  # at most 2 * (BINS + 2) rows
            bins[k, toxic] = n
        smooth = (bins[:, 1] + rate) / (bins.sum(1) + 1)
        model.without = float(smooth[-1])
        model.table = monotone(smooth[:-1], bins[:-1].sum(1) + 1)
        return model


def _chosen(learn: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxic, at, tf): learned rows over the vocabulary."""
    shared = learn.sparkSession.sparkContext.broadcast(model.vocabulary)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lists = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            known, at = in_vocabulary(shared.value, lists.flatten().to_numpy())
            cut = np.searchsorted(doc[known], np.arange(batch.num_rows + 1)).astype(np.int32)
            tf = batch.column("tf").flatten().to_numpy()[known]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(cut, pa.array(at)), pa.ListArray.from_arrays(cut, pa.array(tf))], names=["doc_id", "toxic", "at", "tf"])

        return step

    return by_batch(learn, "doc_id long, toxic int, at array<long>, tf array<long>", make)


def _left_out(chosen: DataFrame, model: Model) -> DataFrame:
    """(bin, toxic) of the learned rows, each scored without its own example; the last bin has those without neighbours."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for doc_id, at, tf in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "tf")), strict=True):
                share = m.share(np.array(at, np.int64), np.array(tf, np.float64), doc_id)[0]
                out.append(BINS + 1 if share is None else int(round(share * BINS)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), batch.column("toxic")], names=["bin", "toxic"])

        return step

    return by_batch(chosen, "bin int, toxic int", make)


EVIDENCE_TYPE = "array<struct<doc_id:bigint,toxic:int,cosine:double>>"


def score(docs: DataFrame, model: Model, out: str = "toxicity", evidence: str = "evidence") -> DataFrame:
    """All columns of docs, `out`, the score of the whole text, and `evidence`, its nearest examples."""
    refuse_clash(docs, out, evidence)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in text_slices(batch.column("text")):
                doc, term = terms(texts)
                known, at = in_vocabulary(m.vocabulary, term)
                doc, at, tf = counted(doc[known], at)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                scores, sizes, near = np.full(len(texts), m.score(None)), np.zeros(len(texts) + 1, np.int32), [(np.zeros(0, np.int64), np.zeros(0))]
                for k in np.unique(doc).tolist():
                    share, rows, cosines = m.share(at[cut[k] : cut[k + 1]], tf[cut[k] : cut[k + 1]].astype(np.float64))
                    scores[k], sizes[k + 1] = m.score(share), len(rows)
                    near.append((rows, cosines))
                rows, cosines = (np.concatenate(x) for x in zip(*near, strict=True))
                ids, labels = (m.index.ids[rows], m.index.labels[rows]) if m.index else (rows, rows)
                found = pa.StructArray.from_arrays([pa.array(ids), pa.array(labels.astype(np.int32)), pa.array(cosines)], names=["doc_id", "toxic", "cosine"])
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores), pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), found)], names=[*names, out, evidence])

        return step

    return by_batch(docs, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{out} double, {evidence} {EVIDENCE_TYPE}"]), make)

"""Composition vectors and their clustering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..scratch import Scratch, written
from . import windows
from .graph import components
from .kmer import same_ids


def qmer_profile(contigs: DataFrame, q: int, owner: str) -> DataFrame:
    """(owner, qmer, n): canonical q-mers of all positions."""
    km = contigs.select(owner, F.explode(S.kmers(F.col("s"), q)).alias("x"))
    return km.groupBy(owner, S.canonical(F.col("x"))["a"].alias("qmer")).agg(F.count(F.lit(1)).alias("n"))


def qmer_vectors(contigs: DataFrame, q: int, owner: str) -> DataFrame:
    """(owner, profile): the share of every canonical q-mer among a contig's positions, in their order; contigs shorter than q have none. q-mers are counted in the row, and
    only rows that share their owner are added up; q is at most 8 or so, since a profile has a place for each q-mer."""
    words = ["".join(w) for w in product("ACGT", repeat=q)]
    slots = sorted({min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in words})
    n = windows.counted(contigs, [owner], q, slots)
    if same_ids(contigs, [owner]):
        n = n.groupBy(owner).agg(F.array(*(F.sum(F.get("n", F.lit(i))) for i in range(len(slots)))).alias("n"), F.sum("total").alias("total"))
    return n.select(owner, F.transform("n", lambda x: x / F.col("total")).alias("profile"))


def kmeans(vectors: DataFrame, k: int, vec: str, seed: int = 7, restarts: int = 1) -> DataFrame:
    """vectors with `cluster`; of several restarts the one with the least cost. Vectors are dense and are compared with all centres in blocks."""
    x = vectors.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    models = [KMeans(k=k, seed=seed + r, maxIter=20, solver="block").fit(x) for r in range(restarts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(x).drop("features").withColumnRenamed("prediction", "cluster")


def iterative_merge(vectors: DataFrame, vec: str, start: int, threshold: float, seed: int = 7, rounds: int = 10) -> DataFrame:
    """vectors with `cluster`: k-means into `start` clusters, then clusters whose mean vectors have a cosine of threshold or more are merged, until
    none are left to merge or the rounds end. Means are one row per cluster, at most `start` of them."""
    with Scratch(vectors.sparkSession) as space:
        x = space.written(kmeans(vectors, start, vec, seed).withColumn("cluster", F.col("cluster").cast("long")))
        for _ in range(rounds):
            mean = x.select("cluster", F.posexplode(vec).alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
            norm = mean.groupBy("cluster").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
            m = mean.join(norm, "cluster").select("cluster", "i", (F.col("v") / F.col("norm")).alias("v"))
            dot = m.alias("a").join(m.alias("b"), F.col("a.i") == F.col("b.i")).where("a.cluster < b.cluster").groupBy(F.col("a.cluster").alias("u"), F.col("b.cluster").alias("v")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("cos"))
            close = space.written(dot.where(F.col("cos") >= threshold).select("u", "v"))
            if close.isEmpty():
                break
            comp = components(close)
            x = space.written(x.join(comp, x.cluster == comp.node, "left").withColumn("cluster", F.coalesce("comp", "cluster")).drop("node", "comp"))
        return written(x)


def spearman_vectors(vectors: DataFrame, owner: str, vec: str) -> DataFrame:
    """(owner, u): the ranks of each vector's components (equal ones share their mean rank), centred and of length 1, so that the dot product
    of two is their Spearman correlation. A vector whose components are all equal has the zero vector."""
    below = lambda x: F.size(F.filter(vec, lambda y: y < x)) + (F.size(F.filter(vec, lambda y: y == x)) + 1) / 2
    r = vectors.select(owner, F.transform(vec, lambda x: below(x) - (F.size(vec) + 1) / 2).alias("r"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x))
    return r.withColumn("norm", norm).select(owner, F.transform("r", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("u"))


def _assigned(units: DataFrame, owner: str, centres: np.ndarray) -> DataFrame:
    """(owner, cluster, near, u): the centre with the largest dot product, the first of equal ones. centres: a row for each cluster, a bounded number."""
    shared = units.sparkSession.sparkContext.broadcast(centres)
    kind = dict((f.name, f.dataType.simpleString()) for f in units.schema)[owner]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                dots = np.round(np.stack(f.u.to_numpy()) @ shared.value.T, 9)
                yield pd.DataFrame({owner: f[owner], "cluster": dots.argmax(1), "near": dots.max(1), "u": f.u})

    return units.select(owner, "u").mapInPandas(run, f"`{owner}` {kind}, cluster long, near double, u array<double>")


def _sums(assigned: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of the vectors and numbers of members by cluster, and the total distance: added in the tasks, then by Spark, so that k * size numbers come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, far = np.zeros((k, size + 1)), 0.0
        for f in frames:
            if len(f):
                rows = np.column_stack([np.stack(f.u.to_numpy()), np.ones(len(f))])
                np.add.at(total, f.cluster.to_numpy(), rows)
                far += float((1 - f.near).sum())
        at = np.flatnonzero(total[:, -1])
        yield pd.DataFrame({"cluster": np.append(np.repeat(at, size + 1), -1), "i": np.append(np.tile(np.arange(size + 1), len(at)), 0), "v": np.append(total[at].ravel(), far)})

    parts = assigned.mapInPandas(run, "cluster long, i long, v double").groupBy("cluster", "i").agg(F.sum(F.rint(F.col("v") * 2.0**30).cast("decimal(38,0)")).cast("double").alias("v"))
    total, far = np.zeros((k, size + 1)), 0.0
    for c, i, v in parts.collect():
        if c < 0:
            far = v / 2.0**30
        else:
            total[c, i] = v / 2.0**30
    return total[:, :-1], total[:, -1], far


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-12, x / np.maximum(size, 1e-12), 0.0)


def spearman_clusters(vectors: DataFrame, owner: str, vec: str, k: int, merge: float, seed: int = 7, restarts: int = 1, rounds: int = 20) -> DataFrame:
    """(owner, cluster, merged): clusters under Spearman distance, and clusters whose centres correlate by `merge` or more made one.

    Each restart begins with the k vectors whose owners have the smallest hashes, assigns all vectors to the nearest centre and moves each centre to
    the mean of its members' ranks, until the total distance falls no more; the restart with the least counts. Then the two most similar centres are merged, weighted by their
    members, as long as their correlation reaches `merge`; a merged cluster has the smallest number of its own. Centres are at most k
    vectors; vectors are assigned and added up in the tasks."""
    with Scratch(vectors.sparkSession) as space:
        units = space.written(spearman_vectors(vectors, owner, vec))
        best: tuple[float, np.ndarray] | None = None
        for r in range(restarts):
            first = units.orderBy(F.xxhash64(F.lit(seed + r), owner), owner).limit(k).collect()  # k rows
            if not first:
                return written(units.select(owner, F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("merged")))
            centres, before = _unit(np.array([x.u for x in first])), np.inf
            for _ in range(rounds):
                sums, _, far = _sums(_assigned(units, owner, centres), len(centres), centres.shape[1])
                if best is None or far < best[0]:
                    best = far, centres
                if far >= before - 1e-9:
                    break
                before = far
                moved = _unit(sums)
                centres = np.where(np.abs(moved).sum(1, keepdims=True) > 0, moved, centres)
        last = space.written(_assigned(units, owner, best[1]))
        sums, members, _ = _sums(last, len(best[1]), best[1].shape[1])
        into = merged_centres(sums, members, merge)
        to = F.array(*(F.lit(int(x)) for x in into))
        return written(last.select(owner, "cluster", F.get(to, F.col("cluster").cast("int")).cast("long").alias("merged")))


def merged_centres(sums: np.ndarray, members: np.ndarray, merge: float) -> np.ndarray:
    """The cluster that each cluster goes to. sums: the members' vectors added up. Of equal correlations the pair with the smallest numbers comes first."""
    into, sums = np.arange(len(sums)), sums.copy()
    alive = members > 0
    while True:
        unit = _unit(sums)
        near = np.round(unit @ unit.T, 9)
        near[~alive] = near[:, ~alive] = -2
        near[np.tril_indices(len(near))] = -2
        a, b = np.unravel_index(np.argmax(near), near.shape)
        if near[a, b] < merge:
            return into
        sums[a] += sums[b]
        alive[b] = False
        into[into == b] = a

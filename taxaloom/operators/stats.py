"""Composition statistics, confidence and confusion summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entropy_majority(counts: DataFrame, owner: list[str], value: str, n: str = "n") -> DataFrame:
    """(owner, entropy, majority): natural-log entropy of a composition and its largest part, ties to the smallest value."""
    t = counts.where(F.col(n) > 0).withColumn("p", F.col(n) / F.sum(n).over(W.partitionBy(*owner)))
    first = F.min(F.struct((-F.col(n)).alias("c"), F.col(value).alias("v")))
    return t.groupBy(*owner).agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"), first["v"].alias("majority"))


def composition(counts: DataFrame, owner: str, n: str = "n") -> DataFrame:
    """(owner, log2_sum, max_share, top2_gap): sum of p log2 p (no minus sign), the largest share, and (largest - second) / sum."""
    w = W.partitionBy(owner)
    t = counts.where(F.col(n) > 0).withColumn("p", F.col(n) / F.sum(n).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(n))))
    second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col(n))), F.lit(0))
    return t.groupBy(owner).agg(F.sum(F.col("p") * F.log2("p")).alias("log2_sum"), (F.max(n) / F.sum(n)).alias("max_share"), ((F.max(n) - second) / F.sum(n)).alias("top2_gap"))


def level_by_entropy(levels: DataFrame, owner: str, level: str, threshold: float) -> DataFrame:
    """(owner, level, entropy, majority): the highest level whose entropy reaches the threshold, else level 0."""
    rank = F.struct((F.col("entropy") >= threshold).cast("int").alias("ok"), F.when(F.col("entropy") >= threshold, F.col(level)).otherwise(-F.col(level)).alias("l"), F.col(level).alias("level"), "entropy", "majority")
    m = levels.groupBy(owner).agg(F.max(rank).alias("m"))
    return m.select(owner, F.col("m.level").alias(level), F.col("m.entropy").alias("entropy"), F.col("m.majority").alias("majority"))


def gaussian_confidence(values: DataFrame, owner: str, value: str, levels: DataFrame) -> DataFrame:
    """(owner, level, confidence): share of the weighted normal densities of all levels up to this one. levels: (level, mean, sd, weight), a
    row per rank, in the order of level; they reach the values as one scalar subquery. A level without a standard deviation above 0 has no
    density, one with a mean near 0 no confidence; densities that sum to nearly 0 are not divided."""
    row = F.struct("level", F.col("mean").cast("double").alias("m"), F.col("sd").cast("double").alias("s"), F.col("weight").cast("double").alias("p"))
    ordered = levels.agg(F.array_sort(F.collect_list(row)).alias("l")).scalar()
    x = F.col("x")
    d = F.when(x["s"] > 0, F.exp(-((F.col("v") - x["m"]) * (F.col("v") - x["m"])) / (2 * x["s"] * x["s"])) / (x["s"] * F.sqrt(2 * F.pi())) * x["p"]).otherwise(0.0)
    e = values.select(owner, F.col(value).alias("v"), F.posexplode(ordered).alias("i", "x")).select(owner, "i", x["level"].alias("level"), x["m"].alias("m"), d.alias("d"))
    w = W.partitionBy(owner)
    run, whole = F.sum("d").over(w.orderBy("i").rowsBetween(W.unboundedPreceding, 0)), F.sum("d").over(w)
    known = F.coalesce(F.abs("m") >= 1e-9, F.lit(False))
    return e.select(owner, "level", F.when(known, F.when(whole > 1e-100, run / whole).otherwise(run)).otherwise(0.0).alias("confidence"))


def confusion_summary(cube: DataFrame, top: int = 7) -> DataFrame:
    """(ref, lower, high, corr, tinc, total) from (ref, pred, correct, n)."""
    r, p, c = F.col("ref"), F.col("pred"), F.col("correct")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    g = cube.groupBy("ref").agg(n((p < r) & (c <= r)).alias("lower"), n((p > r) & (p < top) & (c == p)).alias("high"), n((p == r) & (c == r)).alias("corr"), n((p < top) & (c < top)).alias("inner"), F.sum("n").alias("total"))
    return g.select("ref", "lower", "high", "corr", (F.col("inner") - F.col("lower") - F.col("high") - F.col("corr")).alias("tinc"), "total")


def confusion_matrix(cube: DataFrame, levels: int) -> DataFrame:
    """(ref, p0 ... p<levels - 1>): the numbers of (ref, pred, n) with a column for each predicted level."""
    return cube.groupBy("ref").pivot("pred", list(range(levels))).agg(F.sum("n")).na.fill(0).select("ref", *(F.col(str(k)).alias(f"p{k}") for k in range(levels)))


def confusion_variants(rows: DataFrame, ref: str, weight: str, variants: dict[str, tuple[str, str]]) -> DataFrame:
    """(variant, ref, pred, correct, n_reads, n_ctgs): rows and the sums of their weights by levels, for each named pair (pred, correct), say of
    the contig itself and of its nearest neighbour. All variants in one pass over the rows."""
    each = F.array(*(F.struct(F.lit(name).alias("variant"), F.col(p).alias("pred"), F.col(c).alias("correct")) for name, (p, c) in variants.items()))
    x = rows.select(F.col(ref).alias("ref"), F.col(weight).alias("w"), F.explode(each).alias("v")).select("ref", "w", "v.*")
    return x.groupBy("variant", "ref", "pred", "correct").agg(F.sum("w").alias("n_reads"), F.count(F.lit(1)).alias("n_ctgs"))


def nearest_split(rows: DataFrame, ref: str, pred: str, correct: str, nearest: str, weight: str) -> DataFrame:
    """(nearest_right, ref, pred, correct, n_reads, n_ctgs): rows and the sums of their weights by levels, apart for those whose nearest neighbour agrees with the truth
    at the reference level or below (nearest, the level at which it agrees, is at most ref) and the others."""
    right = (F.col(nearest) <= F.col(ref)).alias("nearest_right")
    return rows.groupBy(right, F.col(ref).alias("ref"), F.col(pred).alias("pred"), F.col(correct).alias("correct")).agg(F.sum(weight).alias("n_reads"), F.count(F.lit(1)).alias("n_ctgs"))


def unassigned_ratio(split: DataFrame, top: int) -> DataFrame:
    """(nearest_right, ref, unassigned): the share of reads that no level below `top` was predicted for."""
    none = F.sum(F.when(F.col("pred") >= top, F.col("n_reads")).otherwise(0))
    return split.groupBy("nearest_right", "ref").agg(F.try_divide(none, F.sum("n_reads")).alias("unassigned"))


def log2_sums(owners: DataFrame, counts: DataFrame, owner: str, empty: float = 1e9) -> DataFrame:
    """(owner, log2_sum) of all owners; an owner without counts gets `empty`."""
    c = composition(counts, owner).select(owner, "log2_sum")
    return owners.select(owner).distinct().join(c, owner, "left").select(owner, F.coalesce("log2_sum", F.lit(empty)).alias("log2_sum"))


def cluster_accuracy(composed: DataFrame, cluster: str, genome: str, n: str = "n") -> DataFrame:
    """One row (precision, sensitivity): the share of the largest genome of each cluster, and of the largest cluster of each genome."""
    best = lambda by, name: composed.groupBy(by).agg(F.max(n).alias("m"), F.sum(n).alias("s")).agg((F.sum("m") / F.sum("s")).alias("r")).withColumn("name", F.lit(name))
    both = best(cluster, "precision").union(best(genome, "sensitivity"))
    return both.agg(*(F.max(F.when(F.col("name") == x, F.col("r"))).alias(x) for x in ("precision", "sensitivity")))


def purity(composed: DataFrame, cluster: str, genome: str, n: str = "n") -> DataFrame:
    """(cluster, purity, majority): the largest share and its genome, ties to the smallest."""
    return composed.groupBy(cluster).agg((F.max(n) / F.sum(n)).alias("purity"), F.min(F.struct((-F.col(n)).alias("c"), F.col(genome).alias("g")))["g"].alias("majority"))


def level_statistics(pairs: DataFrame, level: str, value: str) -> DataFrame:
    """(level, mean, sd, n) of similarities by the level that two genomes share."""
    return pairs.groupBy(level).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))

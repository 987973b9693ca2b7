"""Levels learned from similarities of genomes, and the descent of candidates along them.

A matrix of similarities and the genomes' lineages give, for each genome and each level at which it meets others, a normal distribution and its
number of pairs. Between a level and the next one lies the boundary at which both are equally likely. Candidates are joined to the levels of their
genome, an array of bounded length, and walk up it in one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import match_level

STEP_BACK = 0.8


def learned(matrix: DataFrame, lineages: DataFrame, levels: int) -> DataFrame:
    """(k, genome, level, n, mean, sd) of the similarities (k, i, j, value) of each genome to those that it shares a level with (the lowest), over all ordered
    pairs and itself; `levels` where none is shared. lineages: (genome, l). k tells the matrices apart."""
    one = lambda g, name: lineages.select(F.col("genome").alias(g), F.col("l").alias(name))
    pairs = matrix.join(one("i", "a"), "i").join(one("j", "b"), "j").withColumn("level", match_level(F.col("a"), F.col("b"), levels))
    return pairs.groupBy("k", F.col("i").alias("genome"), "level").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def crossing(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Where n1 N(m1, s1) and n2 N(m2, s2) are equal between the means; the middle of the means if they are not, or a distribution has no width."""
    a = 1 / (2 * s1 * s1) - 1 / (2 * s2 * s2)
    b = m2 / (s2 * s2) - m1 / (s1 * s1)
    c = m1 * m1 / (2 * s1 * s1) - m2 * m2 / (2 * s2 * s2) + F.log(n2 * s1 / (n1 * s2))
    root = b * b - 4 * a * c
    low, high = F.least(m1, m2), F.greatest(m1, m2)
    inside = lambda x: F.when((x >= low) & (x <= high), x)
    curved = F.coalesce(inside((-b - F.sqrt(root)) / (2 * a)), inside((-b + F.sqrt(root)) / (2 * a)))
    x = F.when(F.abs(a) < 1e-12, inside(-c / F.when(b != 0, b))).when(root >= 0, curved)
    return F.coalesce(F.when((s1 > 0) & (s2 > 0), x), (m1 + m2) / 2)


def boundaries(stats: DataFrame, levels: int) -> DataFrame:
    """(k, genome, means, upper): arrays by level; a level that a genome shares with none has neither. upper: the boundary to the next level that it has."""
    cell = F.array_sort(F.collect_list(F.when(F.col("level") < levels, F.struct("level", "mean", "sd", F.col("n").cast("double").alias("n")))))
    g = stats.groupBy("k", "genome").agg(cell.alias("c"))
    step = lambda x, i: F.struct(x["level"].alias("level"), F.when(i + 1 < F.size("c"), _between(x, F.get("c", i + 1))).alias("upper"))
    g = g.withColumn("u", F.transform("c", step))
    at = lambda name, values, k: F.get(F.filter(values, lambda x: x["level"] == k), F.lit(0))[name]
    by_level = lambda name, values: F.array(*(at(name, values, k) for k in range(levels)))
    return g.select("k", "genome", by_level("mean", F.col("c")).alias("means"), by_level("upper", F.col("u")).alias("upper"))


def _between(x: Column, y: Column) -> Column:
    return crossing(x["mean"], F.when(x["sd"] > 0, x["sd"]), x["n"], y["mean"], F.when(y["sd"] > 0, y["sd"]), y["n"])


def descended(candidates: DataFrame, bounds: DataFrame, levels: int) -> DataFrame:
    """candidates (k, genome, score, level) with `by_boundary`, the level after rising one level while the score is below the boundary, and `by_mean`, the level
    after rising while the score is below the level's mean, with a step back where it stops if the score reaches 0.8 of the mean one level lower.
    A level without a boundary or mean stops nothing; the top level is the last. Candidates of unknown genomes keep their level."""
    j = candidates.join(bounds, ["k", "genome"], "left")
    walk = F.sequence(F.lit(0), F.lit(levels - 2)) if levels > 1 else F.array().cast("array<int>")
    start = F.struct(F.col("level").cast("int").alias("at"), F.col("means").isNull().alias("done"))
    state = lambda at, done: F.struct(at.cast("int").alias("at"), done.alias("done"))

    def rise(s: Column, k: Column) -> Column:
        stop = F.coalesce(F.col("score") >= F.get("upper", k), F.lit(False))
        return F.when(s["done"] | (k < s["at"]), s).otherwise(state(F.when(stop, s["at"]).otherwise(k + 1), stop))

    def fall(s: Column, k: Column) -> Column:
        stop = F.coalesce(F.col("score") >= F.get("means", k), F.lit(False))
        back = stop & (k > 0) & F.coalesce(F.col("score") >= F.get("means", F.greatest(k - 1, F.lit(0))) * STEP_BACK, F.lit(False))
        return F.when(s["done"] | (k < s["at"]), s).otherwise(state(F.when(back, k - 1).when(stop, s["at"]).otherwise(k + 1), stop))

    return j.select(*candidates.columns, F.aggregate(walk, start, rise)["at"].cast("long").alias("by_boundary"), F.aggregate(walk, start, fall)["at"].cast("long").alias("by_mean"))

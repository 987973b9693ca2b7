"""Translated search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S


def protein_index(targets: DataFrame, k: int, target: str) -> DataFrame:
    """Distinct (target, kmer) of the first frame's proteins."""
    return targets.select(target, F.explode(F.array_distinct(S.kmers(S.translate_codons(F.col("s")), k))).alias("kmer")).distinct()


def protein_search(contigs: DataFrame, index: DataFrame, k: int, owner: str, target: str) -> DataFrame:
    """(owner, target, score): each distinct k-mer of a frame gives 1 / (number of its targets); a target's score is that of its best frame."""
    f = contigs.select(owner, F.explode(S.six_frames(F.col("s"))).alias("f"))
    km = f.select(owner, F.col("f.frame").alias("frame"), F.explode(F.array_distinct(S.kmers(F.col("f.protein"), k))).alias("kmer"))
    weighted = index.withColumn("share", 1.0 / F.count(F.lit(1)).over(W.partitionBy("kmer")))
    by_frame = km.join(weighted, "kmer").groupBy(owner, "frame", target).agg(F.sum("share").alias("score"))
    return by_frame.groupBy(owner, target).agg(F.max("score").alias("score"))

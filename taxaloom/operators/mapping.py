"""Reads on contigs: seeds, verification, and links between contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from .seeds import seeded


def map_reads(reads: DataFrame, contigs: DataFrame, k: int, least: Column) -> DataFrame:
    """(read_id, ctg_id, pos, score): the contig and place (from 0) where a whole read has most equal bases, among places that share a
    k-mer; ties to the smallest contig and place. reads: (read_id, s), contigs: (ctg_id, s). least: which places count, by score and size."""
    best = _best_place(_places(reads, contigs, ["read_id"], k, least), "ctg_id", "pos")
    return best.select("read_id", "m.ctg_id", "m.pos", (-F.col("m.s")).alias("score"))


def _places(reads: DataFrame, contigs: DataFrame, ids: list[str], k: int, least: Column) -> DataFrame:
    """(*ids, ctg_id, pos, score, size): places of whole reads on contigs."""
    found = seeded(contigs, reads, ["ctg_id"], ids, k, "d >= 0 and d + nb <= na")
    return found.select(*ids, "ctg_id", F.col("d").cast("long").alias("pos"), F.col("match").alias("score"), F.col("nb").alias("size")).where(least)


def _best_place(places: DataFrame, *order: str) -> DataFrame:
    return places.groupBy("read_id").agg(F.min(F.struct((-F.col("score")).alias("s"), *order)).alias("m"))


def strands(reads: DataFrame) -> DataFrame:
    """(read_id, strand, s): each read as it is (strand 0) and as its reverse complement (1)."""
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col("s").alias("s")), F.struct(F.lit(1).alias("strand"), S.reverse_complement(F.col("s")).alias("s")))
    return reads.select("read_id", F.explode(both).alias("x")).select("read_id", "x.strand", "x.s")


def map_both_strands(reads: DataFrame, contigs: DataFrame, k: int, least: Column) -> DataFrame:
    """(read_id, ctg_id, pos, strand, score): as map_reads, of both strands of a read, in one pass over the contigs; of equal places the forward strand."""
    best = _best_place(_places(strands(reads), contigs, ["read_id", "strand"], k, least), "ctg_id", "pos", "strand")
    return best.select("read_id", "m.ctg_id", "m.pos", "m.strand", (-F.col("m.s")).alias("score"))


def contig_read_edges(contigs: DataFrame, reads: DataFrame, k: int, seed: int, large: int = 8000, small: int = 1000) -> DataFrame:
    """(ctg_id, read_id): contigs and reads that overlap well in either orientation of the read, which may hang over the contig's ends.
    Two long ones (both of `small` or more, one of `large` or more) are not joined."""
    na, nb = F.col("na"), F.col("nb")
    found = seeded(contigs, strands(reads), ["ctg_id"], ["read_id", "strand"], k, ((na < large) & (nb < large)) | (na < small) | (nb < small))
    return found.where(good_overlap(F.col("match"), F.col("mismatch"), seed)).select("ctg_id", "read_id").distinct()


def overlap_edges(reads: DataFrame, k: int, least: Column) -> DataFrame:
    """(u, v) of reads (id, s) that share a k-mer at a shift at which they overlap well: least(match, mismatch) decides."""
    one, other = (reads.select(F.col("id").alias(x), "s") for x in "uv")
    return seeded(one, other, ["u"], ["v"], k, "u < v").where(least).select("u", "v").distinct()


def good_overlap(match: Column, mismatch: Column, seed: int = 50, r: float = 0.01) -> Column:
    """Whether an overlap is long enough and its equal bases beyond the seed reach the binomial bound of its length beyond the seed."""
    return (match >= seed) & (match - seed >= S.binomial_bound(match + mismatch - seed, r))


def group_links(groups: DataFrame, mapped: DataFrame) -> DataFrame:
    """(u, v): contigs of the two reads of each group; groups: (type, newtype) read numbers, mapped: (read_id, ctg_id). Unmapped reads link nothing."""
    a = mapped.select(F.col("read_id").alias("type"), F.col("ctg_id").alias("x"))
    b = mapped.select(F.col("read_id").alias("newtype"), F.col("ctg_id").alias("y"))
    e = groups.join(a, "type").join(b, "newtype").where("x <> y")
    return e.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def read_links(mapped: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): contigs that overlapping reads join; pairs: (u, v) of read numbers."""
    return group_links(pairs.select(F.col("u").alias("type"), F.col("v").alias("newtype")), mapped)


def pair_mapping(mates: DataFrame, pair: str, mate: str, target: str, score: str) -> DataFrame:
    """(kind, score, n): pairs with both mates (0 and 1) by how they map: `mixed` to two targets, `unmapped` both, `half` by the score of
    the mate that does not map; target is null for a mate that does not map. Pairs on one target are not listed."""
    one = lambda m: F.max(F.when(F.col(mate) == m, F.struct(F.col(target).alias("t"), F.col(score).alias("s"))))
    p = mates.groupBy(pair).agg(one(0).alias("a"), one(1).alias("b")).where("a is not null and b is not null")
    t0, t1, s0, s1 = F.col("a.t"), F.col("b.t"), F.col("a.s"), F.col("b.s")
    kind = F.when(t0.isNull() & t1.isNull(), "unmapped").when(t0.isNull() | t1.isNull(), "half").when(t0 != t1, "mixed")
    p = p.select(kind.alias("kind"), F.when(kind == "half", F.when(t0.isNull(), s0).otherwise(s1)).cast("long").alias("score"))
    return p.where("kind is not null").groupBy("kind", "score").agg(F.count(F.lit(1)).alias("n"))


def near_best(scores: DataFrame, owner: str, share: float) -> DataFrame:
    """Scores of at least share of the owner's best."""
    return scores.withColumn("__best", F.max("score").over(W.partitionBy(owner))).where(F.col("score") >= share * F.col("__best")).drop("__best")


def risen_level(score: Column, thresholds: list[float]) -> Column:
    """The lowest level whose threshold the score reaches; the number of levels if none."""
    out = F.lit(len(thresholds))
    for k in reversed(range(len(thresholds))):
        out = F.when(score >= thresholds[k], k).otherwise(out)
    return out

"""k-mer joins and hit scores.

Pairs are made distinct per owner before the join, the join is on the k-mer alone (a small index is broadcast
by the optimizer, a large one shuffled), and counts are combined in the tasks before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import windows

#: An index of at most this many rows is broadcast.
LISTED = 500_000


def kmer_index(targets: DataFrame, k: int, *ids: str) -> DataFrame:
    """Distinct (*ids, kmer) of the forward strand."""
    return targets.select(*ids, F.explode(F.array_distinct(S.kmers(F.col("s"), k))).alias("kmer")).distinct()


def suffix_index(targets: DataFrame, ks: list[int], *ids: str) -> DataFrame:
    """Distinct (*ids, kmer) of all lengths ks of the forward strand, from one pass over the longest windows: a shorter k-mer is the front of the window
    that starts where it does, and the windows at a sequence's end are as long as what is left. Lengths need no column, k-mers of different lengths differ."""
    return targets.select(*ids, F.explode(_fronts(F.col("s"), ks)).alias("kmer")).distinct()


def _fronts(s: Column, ks: list[int]) -> Column:
    windows = S.kmers(F.concat(s, F.lit("$" * (max(ks) - min(ks)))), max(ks))
    fronts = lambda w: F.array(*(F.substr(w, F.lit(1), F.lit(k)) for k in sorted(ks)))
    return F.array_distinct(F.filter(F.flatten(F.transform(windows, fronts)), lambda x: ~F.contains(x, F.lit("$"))))


def pair_index(index: DataFrame, *targets: str) -> DataFrame:
    """Distinct (*targets, a, share): a is a k-mer of the index or its opposite, so that an owner's canonical pair hits what its smaller k-mer alone meets here;
    share: 1 / the number of targets of a, which are those that a pair's hit is shared among."""
    both = index.select(*targets, F.explode(F.array_distinct(F.array("kmer", windows.opposite(F.col("kmer"))))).alias("a")).distinct()
    return both.withColumn("share", 1.0 / F.count(F.lit(1)).over(W.partitionBy("a")))


def shared_hits(owners: DataFrame, index: DataFrame, ks: list[int], ids: list[str], targets: list[str], repeated: bool | None = None) -> DataFrame:
    """Distinct (*ids, a, *targets, share) of the lengths ks: as pair_hits, with each hit's share, without an exchange of the hits.

    A row's pairs are made distinct within the row, where those that the index does not hold are left out; they are exchanged only if rows share their ids (repeated;
    counted by default). Pairs meet the index by their smaller k-mer alone."""
    held = pair_index(index, *targets)
    if held.limit(LISTED + 1).count() <= LISTED:
        held = F.broadcast(held)
    probes = windows.canonical_pairs(owners, ids, ks, held.select(F.col("a").alias("kmer")).distinct())
    if same_ids(owners, ids) if repeated is None else repeated:
        probes = probes.distinct()
    return probes.join(held, "a")


def same_ids(owners: DataFrame, ids: list[str]) -> bool:
    """Whether rows share their ids."""
    return not owners.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def fragment_hits(contigs: DataFrame, index: DataFrame, k: int, width: int, owner: str, target: str) -> DataFrame:
    """shared_hits of the fragments of contigs: (owner, frag, a, target, share)."""
    return shared_hits(fragments(contigs, width, owner), index, [k], [owner, "frag"], [target], same_ids(contigs, [owner]))


def sum_of_shares(hits: DataFrame, *by: str) -> DataFrame:
    """fractional_hits of shared_hits."""
    return hits.groupBy(*by).agg(F.sum("share").alias("score"))


def fragments(contigs: DataFrame, width: int, *ids: str) -> DataFrame:
    """(*ids, frag, s)."""
    f = contigs.select(*ids, F.explode(S.fragments(F.col("s"), width)).alias("f"))
    return f.select(*ids, F.col("f.frag").alias("frag"), F.col("f.seq").alias("s"))


def pair_hits(owners: DataFrame, index: DataFrame, k: int, *ids: str) -> DataFrame:
    """Distinct (*ids, a, item columns): the targets that either strand of a distinct canonical pair meets. a names the pair.

    Hits are dealt by owner and pair once; making them distinct and sharing a pair among its targets then need no further exchange."""
    pairs = owners.select(*ids, F.explode(S.canonical_pairs(F.col("s"), k)).alias("p"))
    probes = pairs.select(*ids, F.col("p.a").alias("a"), F.explode(F.array_distinct(F.array("p.a", "p.b"))).alias("kmer"))
    return probes.join(index, "kmer").drop("kmer").repartition(*ids, "a").distinct()


def unit_hits(hits: DataFrame, *by: str) -> DataFrame:
    """Number of distinct pairs that hit."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def fractional_hits(hits: DataFrame, owner: list[str], target: list[str]) -> DataFrame:
    """Each pair of an owner gives 1 / (number of its targets) to each of them."""
    each = hits.withColumn("share", 1.0 / F.count(F.lit(1)).over(W.partitionBy(*owner, "a")))  # dealt so by pair_hits
    return each.groupBy(*owner, *target).agg(F.sum("share").alias("score"))


def best(scores: DataFrame, owner: str, target: str, score: str = "score") -> DataFrame:
    """(owner, target, score): the highest score, ties to the smallest target."""
    top = scores.groupBy(owner).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(target)).alias("t"))).alias("m"))
    return top.select(owner, (-F.col("m.t")).alias(target), F.col("m.s").alias(score))


def best_or_fixed(scores: DataFrame, fixed: DataFrame, owner: str, target: str) -> DataFrame:
    """(owner, target, score): the fixed target of an owner that has one, with its own score, else the best; a null owner is one of its own.
    fixed: (owner, target, score)."""
    both = best(scores, owner, target).withColumn("__fixed", F.lit(0)).unionByName(fixed.select(owner, target, "score").withColumn("__fixed", F.lit(1)))
    m = both.groupBy(owner).agg(F.max_by(F.struct(target, "score"), "__fixed").alias("m"))
    return m.select(owner, F.col(f"m.{target}").alias(target), F.col("m.score").alias("score"))


def top(scores: DataFrame, owner: str, target: str, n: int, score: str = "score") -> DataFrame:
    """The n highest per owner, with rank; ties to the smallest target. Spark drops all below rank n before the shuffle."""
    w = W.partitionBy(owner).orderBy(F.desc(score), F.asc(target))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def genome_vote(scores: DataFrame, owner: str, target: str, genome: Column, n: int = 10) -> DataFrame:
    """(owner, genome, share): the genome with more than half of the sum of the n best targets."""
    t = top(scores, owner, target, n).withColumn("genome", genome)
    g = t.groupBy(owner, "genome").agg(F.sum("score").alias("part"))
    g = g.withColumn("share", F.col("part") / F.sum("part").over(W.partitionBy(owner)))
    return g.where("share > 0.5").select(owner, "genome", "share")


def frequent_kmer_argmax(contigs: DataFrame, index: DataFrame, k: int, owner: str, target: str) -> DataFrame:
    """k-mers that one target alone owns vote, as often as they occur on either strand (a palindrome twice); (-1, -1) without a vote."""
    alone = index.groupBy("kmer").agg(F.count(F.lit(1)).alias("c"), F.min(target).alias(target)).where("c = 1").drop("c")
    one = contigs.select(owner, F.explode(S.kmers(F.col("s"), k)).alias("f"))
    both = one.select(owner, F.explode(F.array("f", S.reverse_complement(F.col("f")))).alias("kmer"))
    votes = both.join(alone, "kmer").groupBy(owner, target).agg(F.count(F.lit(1)).alias("n"))
    won = best(votes, owner, target, "n")
    return contigs.select(owner).join(won, owner, "left").select(owner, F.coalesce(target, F.lit(-1)).alias(target), F.coalesce("n", F.lit(-1)).alias("n"))

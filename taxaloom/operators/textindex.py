"""Common k-mers and the classification of reads by k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..scratch import Scratch, written
from . import windows
from .kmer import same_ids

#: Steps of an extension that one pass over the index answers: at most 2 ** AT_ONCE patterns are looked up for a k-mer.
AT_ONCE = 3


def common_kmers(texts: DataFrame, group: str, member: str, k: int) -> DataFrame:
    """(group, kmer): k-mers that every member of a group holds."""
    size = texts.groupBy(group).agg(F.count_distinct(member).alias("size"))
    km = texts.select(group, member, F.explode(F.array_distinct(S.kmers(F.col("s"), k))).alias("kmer")).distinct()
    return km.groupBy(group, "kmer").agg(F.count(F.lit(1)).alias("c")).join(size, group).where("c = size").select(group, "kmer")


def classify_reads(reads: DataFrame, index: DataFrame, k: int, ext: int, more_than: int, owner: str) -> DataFrame:
    """(owner, n): distinct k-mers of a read that, with the ext characters before them (of the last occurrence), occur in more than more_than texts of the index.

    Windows travel as numbers, and are made distinct within their row, unless rows share an owner or windows are too long for a number."""
    if k + ext <= windows.LONGEST and not same_ids(reads, [owner]) and not same_ids(index, [owner]):
        w = windows.coded(index, [owner], k + ext, k + ext)
        frequent = w.groupBy("code", "odd").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") > more_than).select("code", "odd")
        return windows.coded(reads, [owner], k + ext, k).join(frequent, ["code", "odd"]).groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    w = index.select(owner, F.explode(F.array_distinct(S.kmers(F.col("s"), k + ext))).alias("long")).distinct()
    frequent = w.groupBy("long").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") > more_than).select("long")
    q = reads.select(owner, F.posexplode(S.kmers(F.col("s"), k + ext)).alias("pos", "long"))
    q = q.groupBy(owner, F.substring("long", ext + 1, k).alias("kmer")).agg(F.max(F.struct("pos", "long"))["long"].alias("long"))
    return q.join(frequent, "long").groupBy(owner).agg(F.count(F.lit(1)).alias("n"))


def classify_extended(reads: DataFrame, index: DataFrame, k: int, ext: int, more_than: int, owner: str) -> DataFrame:
    """(owner, n): distinct k-mers of a read that occur, with what fits of the ext characters before them, in more than more_than texts of the index.

    A pattern starts as the k-mer (of its last occurrence in the read). Each character before it, from the nearest on, is put in front of the pattern if the index
    holds the longer pattern, and is skipped if not. All that AT_ONCE steps may ask of the index is looked up in one pass over its rows, which send the patterns that they hold, and no
    others; patterns longer than a number holds are found in a table of all windows after the k-mers of the reads."""
    with Scratch(reads.sparkSession) as space:
        q = reads.select(owner, F.posexplode(S.kmers(F.concat(F.lit("^" * ext), "s"), k + ext)).alias("pos", "long"))
        q = q.groupBy(owner, F.substring("long", ext + 1, k).alias("kmer")).agg(F.max(F.struct("pos", "long"))["long"].alias("long"))
        asked = space.written(q.select(owner, "kmer", F.regexp_replace(F.substring("long", 1, ext), r"\^", "").alias("before")))
        state = space.written(asked.select("kmer", "before").distinct().select("kmer", "before", F.col("kmer").alias("pattern"), F.lit(None).cast("long").alias("texts")))
        kmers = space.written(state.select("kmer").distinct())
        if k + ext <= windows.LONGEST:
            texts = space.written(index.select(owner, "s"))
            ids = [owner] if same_ids(texts, [owner]) else []
            near = windows.known(kmers, k)
        else:
            every = space.written(_all_patterns(index, kmers, k, ext, owner))
        for first in range(1, max(ext, 1) + 1, AT_ONCE):
            steps = range(first, min(first + AT_ONCE, ext + 1))
            before = lambda step: F.substr("before", F.length("before") - (step - 1), F.lit(1))
            if k + ext <= windows.LONGEST:
                wanted = F.array("pattern")
                for step in steps:
                    wanted = F.when(F.length("before") >= step, F.concat(wanted, _fronted(wanted, before(step)))).otherwise(wanted)
                wanted = space.written(state.select(F.explode(wanted).alias("pattern")).distinct())
                found = windows.held(texts, ids, wanted, near, k)
                found = found.distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n")) if ids else found.groupBy("pattern").agg(F.sum("texts").alias("n"))
                found = space.written(found.join(wanted, "pattern", "left_semi"))
            else:
                found = every
            wider = found.select(F.col("pattern").alias("wider"), "n")
            if first == 1:
                state = state.join(found, "pattern", "left").select("kmer", "before", "pattern", F.col("n").alias("texts"))
            for step in steps:
                j = state.withColumn("wider", F.when(F.length("before") >= step, F.concat(before(step), "pattern"))).join(wider, "wider", "left")
                state = j.select("kmer", "before", F.when(F.col("n").isNull(), F.col("pattern")).otherwise(F.col("wider")).alias("pattern"), F.coalesce("n", "texts").alias("texts"))
            state = space.written(state)
        frequent = state.where(F.col("texts") > more_than).select("kmer", "before")
        return written(asked.join(frequent, ["kmer", "before"]).groupBy(owner).agg(F.count(F.lit(1)).alias("n")))


def _fronted(patterns: Column, character: Column) -> Column:
    return F.transform(patterns, lambda x: F.concat(character, x))


def _all_patterns(index: DataFrame, kmers: DataFrame, k: int, ext: int, owner: str) -> DataFrame:
    """(pattern, n): the k to k + ext characters that end with one of the k-mers, with the number of texts that hold them."""
    w = index.select(F.col(owner).alias("text"), F.explode(S.kmers(F.concat(F.lit("^" * ext), "s"), k + ext)).alias("w"))
    w = w.join(kmers, F.substring("w", ext + 1, k) == F.col("kmer"), "left_semi")
    longer = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ext + 1)), lambda i: F.substr("w", i, F.lit(k + ext))), lambda x: ~F.startswith(x, F.lit("^")))
    return w.select("text", F.explode(longer).alias("pattern")).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))

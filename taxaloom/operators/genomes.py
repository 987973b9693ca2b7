"""Building a k-mer index from genomes: taxa of sequences, gene regions, and the k-mers of the genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.readers import valid_regions
from .report import joined_in_order

#: Stands between the regions of a genome; it is no base, so no k-mer of bases spans two regions.
SEPARATOR = "M"


def with_taxon(sequences: DataFrame, seq_tax: DataFrame) -> DataFrame:
    """Sequences (seqid, s) with their taxid; sequences without one are dropped. A short table of taxa is broadcast by the optimizer."""
    return sequences.join(seq_tax.select("seqid", "taxid"), "seqid")


def genes(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """(seqid, start, end, gene): the bases of each valid region (1-based, inclusive) of its sequence, and the sequence's other columns."""
    valid = valid_regions(regions, sequences.select("seqid", F.length("s").alias("len"))).select("seqid", "start", "end")
    cut = F.substr("s", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    return sequences.join(valid, "seqid").withColumn("gene", cut).drop("s")


def joined_genes(g: DataFrame) -> DataFrame:
    """(seqid, text): the regions of a sequence in their order, each followed by the separator. A sequence has a bounded number of regions."""
    order = F.struct("start", "end")
    return g.groupBy("seqid").agg(F.concat(joined_in_order(F.col("gene"), order, SEPARATOR), F.lit(SEPARATOR)).alias("text"))


def genome_index(sequences: DataFrame, seq_tax: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """Distinct (taxid, kmer) of the genes of all sequences that have a taxon."""
    g = genes(with_taxon(sequences, seq_tax), regions)
    return g.select("taxid", F.explode(F.array_distinct(S.kmers(F.col("gene"), k))).alias("kmer")).distinct()


def edge_strings(sequences: DataFrame, owner: str, longest: int, shortest: int) -> DataFrame:
    """(owner, side, size, part): prefixes and suffixes of the sizes from longest - 1 down to shortest, of sequences that are long enough."""
    sizes = F.filter(F.sequence(F.lit(shortest), F.lit(longest - 1)), lambda n: n <= F.length("s"))
    both = lambda n: F.array(F.struct(F.lit("prefix").alias("side"), n.alias("size"), F.substr("s", F.lit(1), n).alias("part")), F.struct(F.lit("suffix").alias("side"), n.alias("size"), F.substr("s", F.length("s") - n + 1, n).alias("part")))
    return sequences.select(owner, F.explode(F.flatten(F.transform(sizes, both))).alias("e")).select(owner, "e.side", F.col("e.size").cast("long").alias("size"), "e.part")


def locate_counts(queries: DataFrame, texts: DataFrame, k: int, query: str) -> DataFrame:
    """(query, n): how often each query's first k-mer occurs in all texts, 0 where it does not; queries shorter than k are left out."""
    q = queries.where(F.length("s") >= k).select(query, F.substr("s", F.lit(1), F.lit(k)).alias("kmer"))
    found = texts.select(F.explode(S.kmers(F.col("s"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return q.join(found, "kmer", "left").select(query, F.coalesce("n", F.lit(0)).alias("n"))

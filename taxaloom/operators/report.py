"""Report relations: groups with their members, labels and unassigned buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written


def joined_in_order(value: Column, order: Column, separator: str) -> Column:
    """An aggregate: values joined in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def ranked(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """All rows of df with their place from 1 in the order of the keys. Range partitions, written once with their numbers, a running
    count within each, and the partitions' totals, one row each."""
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    m = written(parts.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    totals = m.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = totals.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = m.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy("__id")))
    return inside.join(before, "__part").select(*df.columns, (F.col("__in") + F.col("__before")).alias(name))


def score_lines(scores: DataFrame, contigs: DataFrame, least: float) -> DataFrame:
    """(ctg_id, line): `target score ...` of scores at or above least; contigs without one get an empty line."""
    s = scores.where(F.col("score") >= least).groupBy("ctg_id").agg(joined_in_order(F.concat_ws(" ", "sid", "score"), F.col("sid"), " ").alias("line"))
    return contigs.select("ctg_id").join(s, "ctg_id", "left").select("ctg_id", F.coalesce("line", F.lit("")).alias("line"))


def bit_strings(flags: DataFrame, owner: str) -> DataFrame:
    """(owner, bits): 0/1 flags in the order of frag."""
    return flags.groupBy(owner).agg(joined_in_order(F.col("flag").cast("string"), F.col("frag"), "").alias("bits"))


def cluster_members(members: DataFrame, titles: DataFrame) -> DataFrame:
    """(cluster, read_id, line): titles of reads by cluster; a read without a title is named `< read id`."""
    j = members.join(titles, "read_id", "left")
    return j.select("cluster", "read_id", F.coalesce("title", F.concat(F.lit("< read "), F.col("read_id").cast("string"))).alias("line"))


def virtual_contigs(contigs: DataFrame, group: str, owner: str, gap: int = 100) -> DataFrame:
    """(group, ids, seq): members joined by a run of N, ids by underscores. Groups are genomes or clusters of bounded length."""
    return contigs.groupBy(group).agg(joined_in_order(F.col(owner).cast("string"), F.col(owner), "_").alias("ids"), joined_in_order(F.col("s"), F.col(owner), "N" * gap).alias("seq"))


def labelled_hits(hits: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(contig, species, gene): genes that hit a contig (contig, gene, identity) with an identity of least or more, with the species that the contig is labelled by (contig, species)."""
    return hits.where(F.col("identity") >= least).join(labels, "contig").select("contig", "species", "gene")


def gene_report(labelled: DataFrame, species: str, gene: str, least: int, top: int, listed: int = 20) -> DataFrame:
    """(species, n_genes, genes): species with at least `least` rows, by number of rows, the first `top`; the first `listed` distinct genes."""
    g = labelled.groupBy(species).agg(F.count(F.lit(1)).alias("n_genes"), F.array_join(F.slice(F.array_sort(F.collect_set(gene)), 1, listed), ",").alias("genes"))
    return g.where(F.col("n_genes") >= least).orderBy(F.desc("n_genes"), species).limit(top)

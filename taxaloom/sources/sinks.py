"""Writers of indexes and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def kmer_index(index: DataFrame, table: str, buckets: int, key: str = "kmer", mode: str = "overwrite") -> None:
    """A table bucketed and sorted by k-mer, so that joins on it need no shuffle of the index."""
    index.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def extend_kmer_index(new: DataFrame, table: str, buckets: int, key: str = "kmer") -> None:
    """Add the rows of new genomes that a bucketed table does not hold yet; it stays bucketed. The rows to add are settled before the table is written to."""
    with Scratch(new.sparkSession) as space:
        held = new.sparkSession.table(table)
        kmer_index(space.written(new.distinct().join(held, held.columns, "left_anti").select(held.columns)), table, buckets, key, "append")


def tab_file(df: DataFrame, path: str, *order: str) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("sep", "\t").csv(path)


def lines(df: DataFrame, path: str, line: str, *order: str) -> None:
    """One text column, in an order over all files."""
    (df.orderBy(*order) if order else df).select(line).write.mode("overwrite").text(path)


def score_file(scores: DataFrame, contigs: DataFrame, bits: DataFrame, path: str, least: float = 5) -> None:
    """Two lines per contig: `id length bits`, and `target score ...`."""
    from ..operators.report import score_lines

    body = score_lines(scores, contigs, least).join(contigs.select("ctg_id", F.length("s").alias("n")), "ctg_id").join(bits, "ctg_id", "left")
    two = F.concat_ws("\n", F.concat_ws(" ", "ctg_id", "n", F.coalesce("bits", F.lit(""))), F.col("line"))
    lines(body.withColumn("two", two), path, "two", "ctg_id")


def contig_score_file(scores: DataFrame, contigs: DataFrame, path: str, least: float = 5) -> None:
    """One line per contig: `id length target score ...`."""
    from ..operators.report import score_lines

    body = score_lines(scores, contigs, least).join(contigs.select("ctg_id", F.length("s").alias("n")), "ctg_id")
    lines(body.withColumn("one", F.concat_ws(" ", "ctg_id", "n", F.when(F.col("line") != "", F.col("line")))), path, "one", "ctg_id")


def info_file(genomes: DataFrame, path: str) -> None:
    """`seqid taxid len path`, separated by tabs, in the order of the sequence ids; readers.index_info reads it."""
    tab_file(genomes.select("seqid", "taxid", "len", "path"), path, "seqid")


def depth_file(depth: DataFrame, path: str) -> None:
    """`pos depth` of nonzero depths, then one line `mean count`."""
    total = depth.where("depth > 0").agg(F.concat_ws("\t", F.avg("depth"), F.count(F.lit(1))).alias("line"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("pos"))
    rows = depth.where("depth > 0").select(F.concat_ws("\t", "pos", "depth").alias("line"), F.lit(0).alias("k"), F.col("pos").cast("long").alias("pos"))
    lines(rows.unionByName(total), path, "line", "k", "pos")


def cluster_file(members: DataFrame, path: str) -> None:
    """`cluster c<TAB>n` before the lines of each cluster's members. members: (cluster, read_id, line)."""
    head = members.groupBy("cluster").agg(F.concat(F.lit("cluster "), F.col("cluster").cast("string"), F.lit("\t"), F.count(F.lit(1)).cast("string")).alias("line")).withColumn("read_id", F.lit(-1).cast("long"))
    lines(members.select("cluster", F.col("read_id").cast("long"), "line").unionByName(head), path, "line", "cluster", "read_id")


def fasta_file(df: DataFrame, path: str, header: str, seq: str, width: int | None = None) -> None:
    """A header line and the sequence, in lines of `width` characters if given."""
    body = F.col(seq) if width is None else F.concat_ws("\n", F.regexp_extract_all(seq, F.lit(f".{{1,{width}}}"), F.lit(0)))
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("r")).write.mode("overwrite").text(path)


def region_file(df: DataFrame, path: str) -> None:
    """`seqid n` and a line `start end` for each of n regions; readers.regions reads it. df: (seqid, start, end), a bounded number for each seqid."""
    pairs = F.array_sort(F.collect_list(F.struct("start", "end")))
    r = df.groupBy("seqid").agg(pairs.alias("p")).select(F.concat_ws("\n", F.concat_ws(" ", "seqid", F.size("p")), F.transform("p", lambda x: F.concat_ws(" ", x["start"], x["end"]))).alias("r"))
    r.write.mode("overwrite").text(path)

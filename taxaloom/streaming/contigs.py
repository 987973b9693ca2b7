"""Contig annotation as a stream: files of contigs are scored against a fixed index as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import kmer


def annotate(contigs: DataFrame, index: DataFrame, k: int, width: int, least: int, owner: str, target: str) -> DataFrame:
    """(owner, target, score): the best fragment's number of distinct pairs, at or above least. The batch form, also run on each micro-batch."""
    hits = kmer.fragment_hits(contigs, index, k, width, owner, target)
    n = kmer.unit_hits(hits, owner, "frag", target)
    return n.groupBy(owner, target).agg(F.max("n").alias("score")).where(F.col("score") >= least)


def stream(spark: SparkSession, folder: str, schema: str, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **how) -> StreamingQuery:
    """Start the stream over Parquet files of contigs (owner column and s). A contig's score needs no other contig, so there is no state and no late row."""
    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(lambda df, n: sink(annotate(df, index, **how), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

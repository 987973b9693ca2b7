"""Helpers that the corpus operators share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word rule here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: A list of at most this many ids is broadcast to pick rows; beyond it the rows are joined by a shuffle.
BROADCAST_IDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. A temporary folder
    of this machine only in a local session without that setting, as in tests; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="taxaloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: later plans start from files that
    survive the loss of an executor, and the lineage stays short."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of intermediate tables, deleted at the end of the block; what outlives it is written by `written`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, scratch(spark)

    def written(self, df: DataFrame) -> DataFrame:
        return written(df, f"{self.path}/{uuid.uuid4().hex}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def refuse_clash(df: DataFrame, *names: str) -> None:
    """The rule of all operators here for columns that they add: the input must not have one of the name."""
    clash = [c for c in df.columns if c in names]
    if clash:
        raise ValueError(f"the input already has the columns {', '.join(clash)}; rename them")


def row_hash(*columns: str) -> Column:
    """With the id, what tells rows of one id apart."""
    return F.xxhash64(*(columns or ("text",)))


def listed(docs: DataFrame, rows: DataFrame, how: str, *columns: str) -> DataFrame:
    """The rows of docs that are among rows (__id, __h), or (left_anti) those that are not; __h is the row_hash of the columns. A short
    list is broadcast after it has been counted, which keeps the texts out of the shuffle."""
    if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    return docs.join(rows, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (row_hash(*columns) == F.col("__h")), how)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no classifier here learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow whose function is built once per task by make()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def streamed_sha256(df: DataFrame, key: list[str], order: list[str], piece: str, separator: str) -> DataFrame:
    """The key's columns and `sha256`, the lower-case digest of each key's pieces in order, with the separator between them. The pieces of a key
    pass through one task sorted, one batch at a time; they are never collected. Keys hold numbers, not null."""
    names = [*key, piece]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema), "sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for *k, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if k != at:
                    if digest:
                        done.append((*at, digest.hexdigest()))
                    at, digest = k, hashlib.sha256()
                else:
                    digest.update(separator.encode())
                digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*key, "sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, digest.hexdigest())], names=[*key, "sha256"])

    return df.repartition(*key).sortWithinPartitions(*key, *order).select(*names).mapInArrow(run, ddl)

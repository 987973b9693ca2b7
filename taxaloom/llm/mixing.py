"""Mixing sources to target weights, in DataFrame functions only.

Tokens (words) are summed by source; each source's target divided by its sum is its repetition rate; a document
is emitted floor(rate) times and once more if a hash of its id, seeded, falls below the fraction.

Targets share the total by weight under a cap of `most` times each source's own size; what a cap cuts off is
shared again by weight among the others. That is a water level: target = min(cap, level * weight), where
level makes the targets add up to the total. Sorting sources by cap / weight gives the level in closed form.

A null source is a source of its own, sorted last. Sources without a word get target 0 and rate 0, and their
documents are emitted once (they take no words). Null and empty texts have size 0. Documents with one id
share their draw; rows with a null id share one too. An empty table gives an empty mix. Texts of any length are counted whole.
`mix` passes all columns through, whatever their names; `with_targets` refuses documents that have a column it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, refuse_clash

WEIGHTS = (5, 2, 1)
MOST = 3
#: A table of sources of at most this many rows is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rate) from a table of (source, size)."""
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = source.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    # The level if this source and all of a higher cap per weight are uncapped.
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped) / (F.sum("weight").over(everything) - used)
    s = s.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), F.col("source").alias("s"), F.col("level").alias("level")))).over(everything)
    s = s.withColumn("target", F.least(F.col("cap"), fits["level"] * F.col("weight")))
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).alias("rate"))


def with_targets(docs: DataFrame, source: DataFrame) -> DataFrame:
    """docs joined to their source's row; a small table of sources is broadcast after it has been counted."""
    refuse_clash(docs, *(c for c in source.columns if c != "source"))
    named = source.withColumnRenamed("source", "__source")
    if named.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return docs.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def copies(rate: Column, doc_id: Column, seed: int = 5) -> Column:
    """How often a document is emitted."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    whole = F.floor(rate)
    return F.when(rate.isNull(), 1).otherwise(whole + (draw < rate - whole).cast("int")).cast("int")


def mix(docs: DataFrame, source: DataFrame, seed: int = 5) -> DataFrame:
    """The mixed documents: each row of docs as often as its source's rate asks."""
    names = docs.columns
    n = copies(F.col("__rate"), F.col("doc_id"), seed)
    return with_targets(docs, source.select("source", F.col("rate").alias("__rate"))).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n))).select(*names)

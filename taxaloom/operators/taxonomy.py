"""Lineages, trees and lowest common ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..scratch import Scratch, written


def lca(taxa: DataFrame, owner: str, lineage: str, levels: int, none_level: int = 99, ignore_missing: bool = False) -> DataFrame:
    """(owner, level, taxon): the lowest level at which all lineages of an owner agree; (none_level, 0) without one.

    A missing rank (0) counts as a value, unless ignore_missing is set."""
    cell = lambda k: F.col(lineage)[k]
    seen = lambda k: F.when(cell(k) != 0, cell(k)) if ignore_missing else cell(k)
    g = taxa.groupBy(owner).agg(*[F.min(seen(k)).alias(f"lo{k}") for k in range(levels)], *[F.max(seen(k)).alias(f"hi{k}") for k in range(levels)])
    level, taxon = F.lit(none_level), F.lit(0)
    for k in reversed(range(levels)):
        agree = F.col(f"lo{k}") == F.col(f"hi{k}")
        level, taxon = F.when(agree, k).otherwise(level), F.when(agree, F.col(f"lo{k}")).otherwise(taxon)
    return g.select(owner, level.alias("level"), taxon.alias("taxon"))


def match_level(a, b, levels: int):
    """The first level at which two lineages hold the same rank other than 0; `levels` if none."""
    out = F.lit(levels)
    for k in reversed(range(levels)):
        out = F.when((a[k] == b[k]) & (a[k] != 0), k).otherwise(out)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(node, above, dist) for all ancestors of each node and the node itself, by doubling: log2(depth) joins. edges: (parent, child)."""
    with Scratch(edges.sparkSession) as space:
        reach, step = space.written(edges.select(F.col("child").alias("node"), F.col("parent").alias("above"), F.lit(1).alias("dist")).distinct()), 1
        while True:
            far = reach.where(F.col("dist") == step)
            more = far.select("node", F.col("above").alias("m"), "dist").join(reach.select(F.col("node").alias("m"), F.col("above").alias("top"), F.col("dist").alias("d2")), "m")
            more = space.written(more.select("node", F.col("top").alias("above"), (F.col("dist") + F.col("d2")).alias("dist")))
            if more.isEmpty():
                break
            reach, step = reach.union(more), step * 2
        nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
        return written(reach.union(nodes.select("node", F.col("node").alias("above"), F.lit(0).alias("dist"))))


def leaf_counts(edges: DataFrame) -> DataFrame:
    """(node, leafnum) of inner nodes: leaves below, a leaf being a node without children."""
    c = closure(edges)
    leaves = edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return c.where("dist > 0").join(leaves, "node").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("leafnum"))


def node_kmers(edges: DataFrame, sequences: DataFrame, k: int) -> DataFrame:
    """(node, leaves, kmer): k-mers that every leaf below an inner node holds; leaves: their number. sequences: (node, s) of the leaves; one without a sequence holds none.

    A leaf's distinct k-mers meet its ancestors, and are counted in the tasks before they are shuffled."""
    up = closure(edges).where("dist > 0")
    inner = edges.select(F.col("parent").alias("node")).distinct()
    leaf = up.join(inner, "node", "left_anti").select("node", "above")
    total = leaf.groupBy("above").agg(F.count(F.lit(1)).alias("leaves"))
    held = sequences.select("node", F.explode(F.array_distinct(S.kmers(F.col("s"), k))).alias("kmer")).distinct()
    n = leaf.join(held, "node").groupBy("above", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, "above").where("n = leaves").select(F.col("above").alias("node"), "leaves", "kmer")


def leaf_parents(edges: DataFrame, least: int = 2) -> DataFrame:
    """(node, children, leaves): nodes with at least `least` children that are leaves."""
    inner = edges.select(F.col("parent").alias("child"), F.lit(1).alias("inner")).distinct()
    e = edges.select("parent", "child").distinct().join(inner, "child", "left")
    g = e.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("inner").isNull()).alias("leaves"))
    return g.where(F.col("leaves") >= least)


def postorder(edges: DataFrame) -> DataFrame:
    """(node, post_id): children in the order of their names before their parent."""
    c = closure(edges)
    size = c.groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    e = edges.select("parent", F.col("child").alias("node")).distinct().join(size, "node")
    before = F.coalesce(F.sum("size").over(W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = e.select("node", before.alias("left"))
    offset = c.join(left.select(F.col("node").alias("above"), "left"), "above", "left").groupBy("node").agg(F.sum(F.coalesce("left", F.lit(0))).alias("offset"))
    return offset.join(size, "node").select("node", (F.col("offset") + F.col("size") - 1).alias("post_id"))


def heavy_children(children: DataFrame, parent: str, child: str, weight: str) -> DataFrame:
    """(parent, child): the child of the largest weight, ties to the smallest."""
    m = children.groupBy(parent).agg(F.max(F.struct(F.col(weight).alias("w"), (-F.col(child)).alias("c"))).alias("m"))
    return m.select(parent, (-F.col("m.c")).alias(child), F.col("m.w").alias(weight))


def sibling_order(children: DataFrame, parent: str, child: str, weight: str) -> DataFrame:
    """Children with their rank by weight, largest first."""
    return children.withColumn("rank", F.row_number().over(W.partitionBy(parent).orderBy(F.desc(weight), child)).cast("long"))


def heavy_paths(edges: DataFrame) -> DataFrame:
    """(node, head): the heavy path of each node, named by its first node. The heavy child has most leaves, ties to the smallest name."""
    leaves = leaf_counts(edges)
    e = edges.select("parent", "child").distinct().join(leaves.withColumnRenamed("node", "child"), "child", "left").withColumn("leafnum", F.coalesce("leafnum", F.lit(1)))
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("leafnum"), "child")))
    light = ranked.where("rank > 1").select(F.col("child").alias("above"))
    roots = edges.select(F.col("parent").alias("above")).distinct().join(edges.select(F.col("child").alias("above")).distinct(), "above", "left_anti")
    heads = light.union(roots)
    m = closure(edges).join(heads, "above").groupBy("node").agg(F.min(F.struct("dist", "above")).alias("m"))
    return m.select("node", F.col("m.above").alias("head"))


def lineage_rollup(counts: DataFrame, lineage: str, count: str) -> DataFrame:
    """(prefix, total): counts summed for every prefix of the lineage."""
    p = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(lineage)), lambda i: F.array_join(F.slice(lineage, 1, i), ";"))).alias("prefix"), F.col(count).alias("c"))
    return p.groupBy("prefix").agg(F.sum("c").alias("total"))


def rank_table(nodes: DataFrame, ranks: list[str]) -> DataFrame:
    """(tid, l): the ancestors (or the node itself) of each node at the given ranks, 0 where one is missing. nodes: (tid, parent, rank)."""
    up = closure(nodes.where("tid <> parent").select("parent", F.col("tid").alias("child")))
    named = up.join(nodes.select(F.col("tid").alias("above"), "rank"), "above")
    at = [F.coalesce(F.min(F.when(F.col("rank") == r, F.struct("dist", "above")))["above"], F.lit(0)).alias(f"r{i}") for i, r in enumerate(ranks)]
    return named.groupBy(F.col("node").alias("tid")).agg(*at).select("tid", F.array(*(F.col(f"r{i}") for i in range(len(ranks)))).alias("l"))

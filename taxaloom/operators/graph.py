"""Pair graphs, connected components, interval islands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch, written

#: Ordered merging runs a connected part of at most this many edges within a task.
PART_EDGES = 200_000


def pair_edges(mates: DataFrame, pair: str, mate: str, node: str) -> DataFrame:
    """(u, v, w) with u < v: how many pairs link two nodes. Mates 0 and 1 of a pair meet in one aggregation, not a join."""
    one = lambda m: F.max(F.when(F.col(mate) == m, F.col(node)))
    p = mates.groupBy(pair).agg(one(0).alias("x"), one(1).alias("y")).where("x <> y")
    return p.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.count(F.lit(1)).alias("w"))


def node_weights(edges: DataFrame) -> DataFrame:
    """(node, weight, degree)."""
    both = edges.select(F.col("u").alias("node"), "w").union(edges.select("v", "w"))
    return both.groupBy("node").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component; edges: (u, v).

    Every round points each node to its smallest neighbour by a random priority, follows the pointers twice and contracts the edges."""
    order = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("n"))
    with Scratch(edges.sparkSession) as space:
        left = space.written(edges.where("u <> v").select("u", "v").distinct())
        root = space.written(left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("root", F.col("node")))
        while not left.isEmpty():
            both = left.union(left.select("v", "u"))
            to = space.written(both.groupBy("u").agg(F.least(F.min(order("v")), F.first(order("u")))["n"].alias("to")).withColumnRenamed("u", "x"))
            for _ in range(2):
                to = space.written(to.join(to.select(F.col("x").alias("to"), F.col("to").alias("far")), "to").select("x", F.col("far").alias("to")))
            root = space.written(root.join(to, root.root == to.x, "left").select("node", F.coalesce("to", "root").alias("root")))
            moved = left.join(to.select(F.col("x").alias("u"), F.col("to").alias("a")), "u").join(to.select(F.col("x").alias("v"), F.col("to").alias("b")), "v")
            left = space.written(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        smallest = root.groupBy("root").agg(F.min("node").alias("comp"))
        return written(root.join(smallest, "root").select("node", "comp"))


def merge_by_ratio(edges: DataFrame, lengths: DataFrame, passes: tuple[tuple[float, bool], ...], limit: int) -> DataFrame:
    """(node, comp): contigs merged in passes. An edge counts in a pass if w / max(W_u, W_v) reaches the pass's ratio and, in a
    guarded pass, its two components are not both longer than limit. All edges of a pass are joined at once, by the lengths
    at the start of the pass, so the result does not depend on an order. lengths: (node, length)."""
    total = node_weights(edges).select("node", F.col("weight").alias("t"))
    r = edges.join(total.select(F.col("node").alias("u"), F.col("t").alias("tu")), "u").join(total.select(F.col("node").alias("v"), F.col("t").alias("tv")), "v")
    r = written(r.select("u", "v", (F.col("w") / F.greatest("tu", "tv")).alias("ratio")))
    comp = total.select("node", F.col("node").alias("comp"))
    for ratio, guarded in passes:
        size = comp.join(lengths, "node").groupBy("comp").agg(F.sum("length").alias("size"))
        c = comp.join(size, "comp")
        e = r.where(F.col("ratio") >= ratio).join(c.select(F.col("node").alias("u"), F.col("comp").alias("cu"), F.col("size").alias("su")), "u").join(c.select(F.col("node").alias("v"), F.col("comp").alias("cv"), F.col("size").alias("sv")), "v")
        if guarded:
            e = e.where((F.col("su") <= limit) | (F.col("sv") <= limit))
        merged = components(e.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        comp = written(comp.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
    return comp


def merge_in_order(edges: DataFrame, lengths: DataFrame, passes: tuple[tuple[float, bool], ...], limit: int) -> DataFrame:
    """(node, comp): as merge_by_ratio, but each pass takes its edges one after another, by (u, v), and a guarded pass skips an edge if both components are longer than
    limit at its turn, so that lengths grow as in a sequential run.

    Connected parts of the open edges do not touch each other. A part of up to PART_EDGES edges is run in order within a task. Of larger parts an edge between two
    components over the limit is settled for good, since lengths only grow, and a part has no edge to skip if it cannot hold two disjoint pieces over the limit: if what it
    is long beyond its longest component, or half of it, is within the limit. Such a part is joined at once. Of any other large part the first half of its edges is
    looked at by itself, down to a single edge, which is always free to act."""
    with Scratch(edges.sparkSession) as space:
        total = node_weights(edges).select("node", F.col("weight").alias("t"))
        r = edges.join(total.select(F.col("node").alias("u"), F.col("t").alias("tu")), "u").join(total.select(F.col("node").alias("v"), F.col("t").alias("tv")), "v")
        r = space.written(r.select("u", "v", (F.col("w") / F.greatest("tu", "tv")).alias("ratio")))
        comp = space.written(total.join(lengths, "node", "left").select("node", F.col("node").alias("comp"), F.coalesce("length", F.lit(0)).cast("long").alias("length")))
        for ratio, guarded in passes:
            open_ = r.where(F.col("ratio") >= ratio).select("u", "v")
            while True:
                size = comp.groupBy("comp").agg(F.sum("length").alias("size"))
                c = comp.select("node", "comp").join(size, "comp")
                side = lambda x, c=c: c.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("size").alias(f"s{x}"))
                e = open_.join(side("u"), "u").join(side("v"), "v").where("cu <> cv")
                if guarded:
                    e = e.where((F.col("su") <= limit) | (F.col("sv") <= limit))
                e = space.written(e)
                if e.isEmpty():
                    break
                part = components(e.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
                named = e.join(part.select(F.col("node").alias("cu"), F.col("comp").alias("part")), "cu")
                small = named.groupBy("part").agg((F.count(F.lit(1)) <= PART_EDGES).alias("small"))
                named = space.written(named.join(small, "part"))
                rest = named.where("not small").select(e.columns)
                to = _settled(named.where("small"), limit) if guarded else part.select("node", F.col("comp").alias("to"))
                if guarded and not rest.isEmpty():
                    acts = _free_edges(rest, size, limit, space)
                    to = to.union(components(acts.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select("node", F.col("comp").alias("to")))
                comp = space.written(comp.join(to.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"), "length"))
                open_ = rest.select("u", "v") if guarded else rest.limit(0).select("u", "v")
        return written(comp.select("node", "comp"))


def _settled(named: DataFrame, limit: int) -> DataFrame:
    """(node, to): components of small parts (part, u, v, cu, cv, su, sv) and the smallest of those that they end in, edges taken in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "v"])
        root = {c: c for c in [*rows.cu, *rows.cv]}
        size = dict(zip([*rows.cu, *rows.cv], [*rows.su, *rows.sv], strict=True))

        def find(x: object) -> object:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(rows.cu, rows.cv, strict=True):
            a, b = find(a), find(b)
            if a != b and (size[a] <= limit or size[b] <= limit):
                low, high = min(a, b), max(a, b)
                root[high], size[low] = low, size[a] + size[b]
        return pd.DataFrame({"node": list(root), "to": [find(x) for x in root]})

    kind = dict((f.name, f.dataType.simpleString()) for f in named.schema)["cu"]
    return named.groupBy("part").applyInPandas(run, f"node {kind}, to {kind}")


def _free_edges(e: DataFrame, size: DataFrame, limit: int, space: Scratch) -> DataFrame:
    """Edges (u, v, cu, cv) that come first in their parts and that the guard cannot skip."""
    free = e.limit(0)
    while not e.isEmpty():
        part = components(e.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        sizes = part.join(size.withColumnRenamed("comp", "node"), "node").groupBy("comp").agg(F.sum("size").alias("whole"), F.max("size").alias("longest"))
        safe = sizes.select("comp", ((F.col("whole") <= 2 * limit) | (F.col("whole") - F.col("longest") <= limit)).alias("safe"))
        named = e.join(part.select(F.col("node").alias("cu"), "comp"), "cu").join(safe, "comp")
        rank = F.row_number().over(W.partitionBy("comp").orderBy("u", "v"))
        named = space.written(named.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("comp"))).withColumn("rank", rank))
        free = free.unionByName(named.where("safe or m = 1").select(e.columns))
        e = space.written(named.where("not safe and m > 1 and rank <= m / 2").select(e.columns))
    return free


def merge_steps(mates: DataFrame, pair: str, mate: str, node: str, lengths: DataFrame, passes: tuple[tuple[float, bool], ...], limit: int) -> DataFrame:
    """(node, comp): contigs merged by their read pairs: the pairs are counted as edges once, then merged pass by pass."""
    return merge_by_ratio(written(pair_edges(mates, pair, mate, node)), lengths, passes, limit)


def islands(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): unions of overlapping or touching intervals."""
    w = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    i = intervals.withColumn("new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    i = i.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return i.groupBy(key, "island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end")).drop("island")


def region_of(probes: DataFrame, regions: DataFrame, key: str, pos: str, end: str, label: str) -> DataFrame:
    """(key, pos, label): the first region whose end is beyond the position, else the last region. One sort per key, no range join."""
    both = probes.select(key, F.col(pos).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("lab")).union(regions.select(key, F.col(end).alias("at"), F.lit(1).alias("kind"), F.col(label).cast("long")))
    # Backwards by place; at equal places a probe is met before the region's end, which is not beyond it.
    back = W.partitionBy(key).orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    last = F.max(F.when(F.col("kind") == 1, F.struct("at", "lab"))).over(whole)["lab"]
    found = both.withColumn("found", F.coalesce(F.last("lab", ignorenulls=True).over(back), last))
    return found.where("kind = 0").select(key, F.col("at").alias(pos), F.col("found").alias(label))

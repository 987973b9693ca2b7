"""Connected components of links between any comparable keys, as Spark joins.

Each round points every node to the smallest of its neighbours and itself by a random priority, follows
pointers twice, and replaces the ends of links by what they point to; links within a group vanish. Random
priorities keep pointer chains short, so a few rounds are enough whatever the shape of the graph.
Minimum per node is aggregated before the shuffle, so a hub with many links costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node with a link, a node that names its component. Null ends are dropped."""
    priority = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("v"))
    with Scratch(links.sparkSession) as space:
        links = space.written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        roots = space.written(nodes.select("node", F.col("node").alias("root")))
        while not links.isEmpty():
            both = links.union(links.select("b", "a"))
            point = both.groupBy("a").agg(F.least(F.min(priority("b")), F.first(priority("a"))).alias("m")).select(F.col("a").alias("x"), F.col("m.v").alias("to"))
            point = space.written(point)
            for _ in range(2):
                far = point.select(F.col("x").alias("to"), F.col("to").alias("far"))
                point = space.written(point.join(far, "to").select("x", F.col("far").alias("to")))
            roots = space.written(roots.join(point, roots.root == point.x, "left").select("node", F.coalesce("to", "root").alias("root")))
            left = links.join(point.select(F.col("x").alias("a"), F.col("to").alias("ta")), "a")
            links = space.written(left.join(point.select(F.col("x").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        return written(roots)

"""The trie of conversation prefixes, from vertical bitmaps.

Conversations are dealt to shards of SHARD neighbouring ids, and their turns to bands of BAND positions, so that a
group has at most SHARD * BAND turns whatever is frequent and however long a conversation is. A group indexes
(position, turn) to the bitset of the conversations that have it. From a node's bitset, depth first: the lowest
conversation that is left names a child's turn, the intersection of the bitset with that turn's posting is the
child, its popcount the members, and its intersection with the conversations that stop there the end list.
A node is named by the sum of 62-bit hashes of its (position, turn)s, twice; by the names the nodes of all shards
are added up and bands connect. Equal prefixes in many shards meet as one row a shard.

Sums over subtrees need no walk: each node's value is given to its smallest member, added up from the end of that
conversation, and every conversation adds what lies behind a node to that node. So each turn is one row, however deep
or broad the trie is. Numbering and adding along a conversation go by bands too (a total for each band, then within it).

Turns are ordered by turn, null first, then by role and text; null role or text reads as empty; repeated rows are turns of their
own. Rows without a conv_id are left out. An empty table has no trie. Texts are hashed whole. Columns beside
conv_id, turn, role and text are not read. Conversations without a turn belong to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, streamed_sha256, written

SHARD = 1024
BAND = 64
#: Names of nodes are sums of hashes modulo this.
NAMES = 1 << 62
NODE = ["k1", "k2", "depth"]


def band(position: Column) -> Column:
    return F.shiftright(position, BAND.bit_length() - 1)


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, n (turns of the conversation), position (from 1), role, text."""
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(band(F.col("turn")), F.lit(-(1 << 60))))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", "n", (F.col("before") + F.row_number().over(inside)).alias("position"), "role", "text")


def hashed(turns: DataFrame) -> DataFrame:
    """Turns with their texts as two hashes and a number of characters."""
    return turns.select(*(c for c in turns.columns if c not in ("role", "text")), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", F.lit(7), "role").alias("h2"), F.length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, convs: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """The turns and the conversations (conv_id, n) after each conversation has taken its first crc32(conv_id) % heads turns from the first of its group of ids.
    turns: conv_id, n, position, h1, h2, chars. convs: conv_id, n."""
    own, head = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = convs.select("conv_id", "n", (own - own % group).alias("base"), head.alias("h"))
    first = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    lead = turns.where((own % group == 0) & (F.col("position") < heads)).select(own.alias("base"), "position", "h1", "h2", "chars")
    took = convs.select("conv_id", "base", "taken").join(lead, "base").where("position <= taken").select("conv_id", "position", "h1", "h2", "chars")
    # How many turns were taken is a matter of the conversation; only those that took fewer than h need to be looked up.
    less = convs.where("taken < h").select("conv_id", "taken")
    rest = turns.withColumn("h", head).where("position > h").join(less, "conv_id", "left")
    rest = rest.select("conv_id", (F.coalesce("taken", "h") + F.col("position") - F.col("h")).alias("position"), "h1", "h2", "chars")
    return rest.unionByName(took), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def shards(convs: DataFrame) -> DataFrame:
    """convs with `shard`, the smallest of SHARD neighbouring ids at most."""
    names = convs.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first = 0, None
        for batch in batches:
            out = []
            for c in batch.column("conv_id").to_pylist():
                if seen % SHARD == 0:
                    first = c
                seen += 1
                out.append(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.int64())], names=[*names, "shard"])

    ordered = convs.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    return ordered.mapInArrow(deal, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in convs.schema), "shard long"]))


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def descend(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard and band. rows: conv_id, position, t1, t2, chars, stop (the conversation's last position), s1, s2 (name of the prefix before the band)."""
    ids = sorted(set(rows.conv_id))
    place = {c: i for i, c in enumerate(ids)}
    first = int(rows.band.iloc[0]) * BAND
    postings: dict[tuple, int] = {}
    present, stops, starts = [0] * BAND, [0] * BAND, {}
    turn: dict[tuple[int, int], tuple] = {}
    for c, p, t1, t2, chars, stop, s1, s2 in zip(*(rows[x].tolist() for x in ("conv_id", "position", "t1", "t2", "chars", "stop", "s1", "s2")), strict=True):
        i, p = place[c], p - first
        bit = 1 << i
        postings[p, t1, t2] = postings.get((p, t1, t2), 0) | bit
        present[p] |= bit
        turn[i, p] = (t1, t2, chars)
        starts[s1, s2] = starts.get((s1, s2), 0) | bit
        if stop:
            stops[p] |= bit
    out: list[tuple] = []
    stack = [(members, 0, s1, s2) for (s1, s2), members in starts.items()]
    while stack:
        parent, p, s1, s2 = stack.pop()
        rest = parent & present[p]
        while rest:
            t1, t2, chars = turn[(rest & -rest).bit_length() - 1, p]
            child = parent & postings[p, t1, t2]
            rest &= ~child
            k1, k2 = (s1 + t1) % NAMES, (s2 + t2) % NAMES
            members = [ids[i] for i in bits(child)]
            out.append((k1, k2, first + p, s1, s2, chars, child.bit_count(), members[0], members, ",".join(str(ids[i]) for i in bits(child & stops[p]))))
            if p + 1 < BAND:
                stack.append((child, p + 1, k1, k2))
    found = pd.DataFrame(out, columns=["k1", "k2", "depth", "p1", "p2", "chars", "n", "smallest", "members", "ends"])
    found.insert(0, "shard", rows.shard.iloc[0])
    return found


LOCAL = "shard long, k1 long, k2 long, depth long, p1 long, p2 long, chars long, n long, smallest long, members array<long>, ends string"


def local_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of every shard. turns: conv_id, position, h1, h2, chars; convs: conv_id, n, shard. A node at depth 0 stands for no turns."""
    name = lambda *c: F.pmod(F.xxhash64(*c), F.lit(NAMES))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("chars"))
    rows = turns.unionByName(root).select("conv_id", "position", band(F.col("position")).alias("band"), name("position", "h1", "h2").alias("t1"), name("h2", "position", "h1").alias("t2"), "chars")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    parts = rows.groupBy("conv_id", "band").agg(F.sum(wide("t1")).alias("t1"), F.sum(wide("t2")).alias("t2"))
    ahead = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.pmod(F.coalesce(F.sum(c).over(ahead), F.lit(0).cast("decimal(38,0)")), F.lit(NAMES).cast("decimal(38,0)")).cast("long")
    parts = parts.select("conv_id", "band", before("t1").alias("s1"), before("t2").alias("s2")).join(convs.select("conv_id", "n", "shard"), "conv_id")
    rows = rows.join(parts, ["conv_id", "band"]).select("shard", "band", "conv_id", "position", "t1", "t2", "chars", (F.col("position") == F.col("n")).alias("stop"), "s1", "s2")
    return rows.groupBy("shard", "band").applyInPandas(descend, LOCAL)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    turns: conv_id, position (from 1, without gaps), h1, h2, chars. convs: conv_id, n, each id once; n may be 0."""
    with Scratch(turns.sparkSession) as space:
        local = space.written(local_nodes(turns, space.written(shards(convs))))
        nodes = space.written(local.groupBy(*NODE).agg(F.sum("n").alias("n_convs"), F.min("smallest").alias("conv_id"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")))
        children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        nodes = space.written(nodes.join(children, NODE, "left").select(*NODE, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
        # Sums over subtrees, along the conversations.
        value = nodes.select("conv_id", "depth", "saved", (F.col("n_children") == 0).cast("long").alias("leaf"))
        path = local.select(*NODE, F.explode("members").alias("conv_id")).join(value, ["conv_id", "depth"], "left").select("conv_id", *NODE, band(F.col("depth")).alias("band"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
        path = space.written(path)
        behind = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
        parts = path.groupBy("conv_id", "band").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
        parts = parts.select("conv_id", "band", *(F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(c) for c in "sl"))
        inside = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        sums = path.join(parts, ["conv_id", "band"]).select(*NODE, (F.sum("saved").over(inside) + F.col("s")).alias("saved"), (F.sum("leaf").over(inside) + F.col("l")).alias("leaves"))
        sums = sums.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
        # A node's smallest member has its parent in the same shard, where a parent has at most SHARD children.
        known = local.select("shard", *NODE, "p1", "p2", "smallest").join(nodes.select(*NODE, "conv_id"), NODE)
        above = known.select("shard", F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
        parents = known.where("smallest = conv_id and depth > 0").join(above, ["shard", "p1", "p2", "depth"]).select(*NODE, "parent_conv_id")
        ends = streamed_sha256(local.where("ends <> ''").select(*NODE, "shard", "ends"), NODE, ["shard"], "ends", ",")
        out = nodes.join(sums, NODE).join(parents, NODE, "left").join(ends, NODE, "left")
        empty = F.sha2(F.lit("").cast("binary"), 256)
        return written(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", empty).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations."""
    with Scratch(conversations.sparkSession) as space:
        turns = space.written(hashed(numbered(conversations)))
        convs = turns.where("position = 1").select("conv_id", "n")
        again, convs = rebuilt(turns, convs, group, heads)
        return trie(again, convs)

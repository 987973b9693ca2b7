"""Suffixes in order by prefix doubling, their common prefixes, and the substrings that all members of a set hold.

No suffix is ever written out. A suffix is a row (owner, member, pos); its first START characters give it a place among the suffixes of
its owner, and as long as suffixes share a place, they are told apart by the place of the suffix 2^k further on: a join and a
count for each doubling, over the suffixes that still share one. An owner may have one text or many (members); a text's end is smaller than any
character, and ends of different members differ, in the order of the members. Places that are shared at a length are kept for that length; from them the common
prefix of two suffixes is read off from the greatest length down.

Work over the order of suffixes is done in blocks of BLOCK rows, which carry a bounded state to the next: one number for a member and a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..scratch import Scratch, written

START = 16
BLOCK = 1 << 16


def placed(rows: DataFrame, keys: list[str | Column], size: str, space: Scratch) -> DataFrame:
    """rows with `ahead`, the sum of size over all rows before in the order of the keys. Range partitions, a running sum in each, and the partitions' totals."""
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    m = space.written(parts.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    total = m.groupBy("__part").agg(F.sum(size).alias("__n"))
    before = total.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a partition
    inside = F.sum(size).over(W.partitionBy("__part").orderBy("__id")) - F.col(size)
    return m.withColumn("__in", inside).join(before, "__part").select(*rows.columns, (F.col("__in") + F.col("__before")).alias("ahead"))


def starts(texts: DataFrame) -> DataFrame:
    """(owner, member, pos, part): the first START characters from every place of every text (owner, member, s), the end too."""
    step = S.CHUNK
    inside = lambda p: F.transform(F.sequence(F.lit(1), F.least(F.length(p), F.lit(step))), lambda i: F.substr(p, i, F.lit(START)))
    every = F.concat(S.in_chunks(F.col("s"), step, step + START - 1, inside), F.array(F.lit("")))
    return texts.select("owner", "member", every.alias("x")).select("owner", "member", F.posexplode("x").alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


@dataclass
class Ordered:
    """order: (owner, member, pos, rank). levels: a length and the suffixes that share it with another one, (owner, member, pos, place). parts: as starts."""

    order: DataFrame
    levels: list[tuple[int, DataFrame]]
    parts: DataFrame


TEXT = ["owner", "member", "pos"]


def ordered(texts: DataFrame, space: Scratch) -> Ordered:
    """The suffixes of all texts (owner, member, s) with their ranks within their owner, from 0."""
    parts = space.written(starts(texts))
    # Texts that end within the first characters differ by their member.
    own = F.when(F.length("part") < START, F.col("member"))
    keyed = parts.select(*TEXT, "part", own.alias("own"))
    sizes = keyed.groupBy("owner", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    first = placed(sizes, ["owner", "part", F.col("own").asc_nulls_last()], "n", space)
    whole = first.groupBy("owner").agg(F.min("ahead").alias("zero"))
    first = first.join(whole, "owner").select("owner", "part", "own", "n", (F.col("ahead") - F.col("zero")).alias("place"))
    same = (keyed.owner == first.owner) & (keyed.part == first.part) & keyed.own.eqNullSafe(first.own)
    rows = space.written(keyed.join(first, same).select(*(keyed[c] for c in TEXT), "place", "n"))
    done, open_ = [rows.where("n = 1").drop("n")], rows.where("n > 1").drop("n")
    levels, size = [], START
    while not open_.isEmpty():
        levels.append((size, open_))
        every = open_
        for x in done:
            every = every.unionByName(x)
        ahead = every.select("owner", "member", (F.col("pos") - size).alias("pos"), F.col("place").alias("next"))
        group, pair = W.partitionBy("owner", "place"), W.partitionBy("owner", "place", "next")
        # A suffix that shares `size` characters with another one has them, so the suffix behind them exists.
        split = open_.join(ahead, TEXT).withColumn("n", F.count(F.lit(1)).over(pair)).withColumn("place", F.col("place") + F.rank().over(group.orderBy("next")) - 1)
        rows = space.written(split.select(*TEXT, "place", "n"))
        done.append(rows.where("n = 1").drop("n"))
        open_, size = rows.where("n > 1").drop("n"), 2 * size
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return Ordered(space.written(every.withColumnRenamed("place", "rank")), levels, parts)


def common_prefixes(o: Ordered, space: Scratch) -> DataFrame:
    """(owner, member, pos, rank, lcp): how many characters each suffix shares with the one before it in order; -1 for an owner's first."""
    before = o.order.select("owner", F.col("member").alias("m2"), F.col("pos").alias("p2"), (F.col("rank") + 1).alias("rank"))
    pair = space.written(o.order.join(before, ["owner", "rank"]).withColumn("lcp", F.lit(0).cast("long")))
    for size, shared in reversed(o.levels):
        at = lambda m, p, name: shared.select("owner", F.col("member").alias(m), F.col("pos").alias(f"{p}_at"), F.col("place").alias(name))  # noqa: B023, E731
        moved = pair.withColumn("pos_at", F.col("pos") + F.col("lcp")).withColumn("p2_at", F.col("p2") + F.col("lcp"))
        both = moved.join(at("member", "pos", "x"), ["owner", "member", "pos_at"], "left").join(at("m2", "p2", "y"), ["owner", "m2", "p2_at"], "left")
        pair = space.written(both.withColumn("lcp", F.when(F.col("x") == F.col("y"), F.col("lcp") + size).otherwise(F.col("lcp"))).select(*pair.columns))
    part = lambda m, p, name: o.parts.select("owner", F.col("member").alias(m), F.col("pos").alias(f"{p}_at"), F.col("part").alias(name))
    moved = pair.withColumn("pos_at", F.col("pos") + F.col("lcp")).withColumn("p2_at", F.col("p2") + F.col("lcp"))
    both = moved.join(part("member", "pos", "x"), ["owner", "member", "pos_at"]).join(part("m2", "p2", "y"), ["owner", "m2", "p2_at"])
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("x"), F.length("y"))), lambda n: F.substr("x", F.lit(1), n) == F.substr("y", F.lit(1), n)))
    found = both.select(*TEXT, "rank", (F.col("lcp") + same).alias("lcp"))
    return space.written(found.unionByName(o.order.where("rank = 0").withColumn("lcp", F.lit(-1).cast("long"))))


NONE, ALL = -1, 1 << 40


def _least_shared(members: list[int], lcp: list[int], carried: dict[int, int], total: int) -> tuple[list[int], dict[int, int]]:
    """For each row of a block in order, the length that the row shares with rows up to it of all `total` members (NONE while one is missing), and what each member
    shares with the block's last row. carried: what each member before the block shares with the row before it.

    Rows up to the present one fall into runs that share the same length with it, longest last; a row closes the runs that share more than it does."""
    value, count, run_of = [], [], {}
    for m, v in sorted(carried.items(), key=lambda x: x[1]):
        if not value or value[-1] != v:
            value.append(v)
            count.append(0)
        count[-1] += 1
        run_of[m] = len(value) - 1
    stamp = list(range(len(value)))  # the stack's runs by name; names of closed runs lead to the run that took them in
    parent = {k: k for k in stamp}
    names = len(value)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    amount = dict(enumerate(count))
    shares = dict(enumerate(value))
    stack = stamp
    low, out = 0, []
    for m, v in zip(members, lcp, strict=True):
        if stack and shares[stack[-1]] > v:
            top = None
            while stack and shares[stack[-1]] > v:
                k = stack.pop()
                if top is None:
                    top = k
                else:
                    parent[k] = top
                    amount[top] += amount[k]
            if stack and shares[stack[-1]] == v:
                parent[top] = stack[-1]
                amount[stack[-1]] += amount[top]
            else:
                shares[top] = v
                stack.append(top)
            low = min(low, len(stack) - 1)
        if m in run_of:
            amount[find(run_of[m])] -= 1
        stack.append(names)
        parent[names], amount[names], shares[names], run_of[m] = names, 1, ALL, names
        names += 1
        while amount[stack[low]] == 0:
            low += 1
        out.append(shares[stack[low]] if len(run_of) == total else NONE)
    return out, {m: shares[find(k)] for m, k in run_of.items()}


def shared_lengths(rows: DataFrame, space: Scratch) -> DataFrame:
    """rows (owner, member, pos, rank, lcp) with `size`, the length of the longest prefix of the suffix that every member of its owner holds."""
    total = rows.groupBy("owner").agg(F.count_distinct("member").alias("total"))
    # Positions of members in a list stand for them; blocks are by rank, so a block has at most BLOCK rows.
    blocks = space.written(rows.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")).join(total, "owner"))

    def state(x: pd.DataFrame) -> pd.DataFrame:
        """What each member of a block shares with the block's last row, and (member null) the least length between its rows."""
        x = x.sort_values("rank")
        least = x.lcp[::-1].cummin()[::-1].tolist()[1:] + [ALL]
        last = {m: e for m, e in zip(x.member.tolist(), least, strict=True)}
        out = pd.DataFrame({"member": [*last, None], "e": [*last.values(), int(x.lcp.min())]})
        return out.assign(owner=x.owner.iloc[0], block=x.block.iloc[0]).astype({"member": "Int64"})[["owner", "block", "member", "e"]]

    kind = dict((f.name, f.dataType.simpleString()) for f in rows.schema)["owner"]
    states = space.written(blocks.select("owner", "block", "rank", "member", "lcp").groupBy("owner", "block").applyInPandas(state, f"owner {kind}, block long, member long, e long"))

    def carry(x: pd.DataFrame) -> pd.DataFrame:
        """What each member shares with the row before each block."""
        now: dict[int, int] = {}
        out = []
        for block, part in x.sort_values("block").groupby("block"):
            out.append((block, list(now), list(now.values())))
            least = int(part.e[part.member.isna()].iloc[0])
            now = {m: min(e, least) for m, e in now.items()}
            own = part[part.member.notna()]
            now |= dict(zip(own.member.astype(int).tolist(), own.e.tolist(), strict=True))
        return pd.DataFrame(out, columns=["block", "members", "es"]).assign(owner=x.owner.iloc[0])[["owner", "block", "members", "es"]]

    carried = space.written(states.groupBy("owner").applyInPandas(carry, f"owner {kind}, block long, members array<long>, es array<long>"))

    def measure(x: pd.DataFrame) -> pd.DataFrame:
        """own: shared with rows up to this one; forward and back: the greatest of these that reach the row from within the block; and the least lengths from there."""
        x = x.sort_values("rank").reset_index(drop=True)
        lcp, first = x.lcp.tolist(), x.iloc[0]
        own, _ = _least_shared(x.member.tolist(), lcp, dict(zip(list(first.members), list(first.es), strict=True)), int(first.total))
        forward, back = list(own), list(own)
        for k in range(1, len(own)):
            forward[k] = max(own[k], min(forward[k - 1], lcp[k]))
        for k in range(len(own) - 2, -1, -1):
            back[k] = max(own[k], min(back[k + 1], lcp[k + 1]))
        from_start = pd.Series(lcp).cummin()
        to_end = pd.Series([*lcp[1:], ALL])[::-1].cummin()[::-1]
        return x[["owner", "member", "pos", "rank", "block", "lcp"]].assign(forward=forward, back=back, from_start=from_start, to_end=to_end)

    measured = space.written(blocks.join(carried, ["owner", "block"]).groupBy("owner", "block").applyInPandas(measure, f"owner {kind}, member long, pos long, rank long, block long, lcp long, forward long, back long, from_start long, to_end long"))
    ends = measured.groupBy("owner", "block").agg(F.max_by("forward", "rank").alias("out"), F.min("lcp").alias("least"), F.min_by("back", "rank").alias("out_back"), F.min_by("lcp", "rank").alias("entry"), F.min_by("to_end", "rank").alias("through"))

    def scan(x: pd.DataFrame) -> pd.DataFrame:
        """What comes to each block from the blocks before it and behind it."""
        x = x.sort_values("block")
        left, right, now = [], [], NONE
        for out, least in zip(x.out.tolist(), x.least.tolist(), strict=True):
            left.append(now)
            now = max(out, min(now, least))
        now = NONE
        for out, entry, through in reversed(list(zip(x.out_back.tolist(), x.entry.tolist(), x.through.tolist(), strict=True))):
            right.append(now)
            now = min(max(out, min(now, through)), entry)
        return pd.DataFrame({"block": x.block.tolist(), "left": left, "right": right[::-1]}).assign(owner=x.owner.iloc[0])[["owner", "block", "left", "right"]]

    sides = ends.groupBy("owner").applyInPandas(scan, f"owner {kind}, block long, left long, right long")
    size = F.greatest("forward", "back", F.least("left", "from_start"), F.least("right", "to_end"), F.lit(0))
    return space.written(measured.join(sides, ["owner", "block"]).select("owner", "member", "pos", "rank", "lcp", size.alias("size")))


def suffix_order(texts: DataFrame, owner: str) -> DataFrame:
    """(owner, rank, pos) of the suffixes of each text (owner, s), the empty suffix first."""
    with Scratch(texts.sparkSession) as space:
        o = ordered(texts.select(F.col(owner).alias("owner"), F.lit(0).cast("long").alias("member"), "s"), space)
        return written(o.order.select(F.col("owner").alias(owner), "rank", "pos"))


def bwt(texts: DataFrame, owner: str) -> DataFrame:
    """(owner, bwt): the character before each suffix in order, the end mark $ before the whole text."""
    with Scratch(texts.sparkSession) as space:
        o = ordered(texts.select(F.col(owner).alias("owner"), F.lit(0).cast("long").alias("member"), "s"), space)
        back = o.parts.select("owner", (F.col("pos") + 1).alias("pos"), F.substr("part", F.lit(1), F.lit(1)).alias("ch"))
        rows = o.order.join(back, ["owner", "pos"], "left").select("owner", F.struct("rank", F.coalesce("ch", F.lit("$")).alias("ch")).alias("x"))
        return written(rows.groupBy(F.col("owner").alias(owner)).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ch"]), "").alias("bwt")))


def lcp_depth(texts: DataFrame, owner: str) -> DataFrame:
    """(owner, end_pos, depth): the longest common prefix with the preceding suffix, the largest for each end position, above 0."""
    with Scratch(texts.sparkSession) as space:
        rows = common_prefixes(ordered(texts.select(F.col(owner).alias("owner"), F.lit(0).cast("long").alias("member"), "s"), space), space)
        return written(rows.where("lcp > 0").groupBy(F.col("owner").alias(owner), (F.col("pos") + F.col("lcp") - 1).alias("end_pos")).agg(F.max("lcp").alias("depth")))


def set_substrings(texts: DataFrame, group: str, member: str, least: int, everywhere: bool = False) -> DataFrame:
    """(group, pos, size): the places (from 0) in a group's first member where a substring of least or more characters that all its members hold starts and
    cannot be made longer at either end; everywhere: (group, member, pos, size), in all members. texts: (group, member, s), a row for each member, whose id is a whole number."""
    with Scratch(texts.sparkSession) as space:
        t = texts.select(F.col(group).alias("owner"), F.col(member).cast("long").alias("member"), "s")
        whole = t.select("owner", "member", F.length("s").cast("long").alias("length"))  # the only member of a set holds all its suffixes
        rows = shared_lengths(common_prefixes(ordered(t, space), space), space).join(whole, ["owner", "member"])
        rows = rows.select("owner", "member", "pos", F.least("size", F.col("length") - F.col("pos")).alias("size")).where("size > 0")
        before = rows.select("owner", "member", (F.col("pos") + 1).alias("pos"), F.col("size").alias("longer"))
        if not everywhere:
            rows = rows.join(t.groupBy("owner").agg(F.min("member").alias("member")), ["owner", "member"], "left_semi")
        kept = rows.where(F.col("size") >= least).join(before, TEXT, "left").where("longer is null or longer <= size")
        return written(kept.select(F.col("owner").alias(group), *([F.col("member").alias(member)] if everywhere else []), "pos", "size"))

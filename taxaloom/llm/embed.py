"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine >= c are at squared distance <= 2 (1 - c). The vectors are rotated by a fixed random
rotation and split into BLOCKS blocks of dimensions; if each block had more than its proportional share of that
squared distance (its share of the dimensions), the whole would exceed it, so linked vectors are within
the budget in some block. Each block is joined by range: a grid over its first GRID coordinates, of cells as wide
as the budget's root, where a vector stays at home and visits the neighbouring cells in reach that come after its own,
so that two cells meet once. Within a cell, tiles of vectors are compared in numpy: first the block's distance, then the
exact cosine in double precision of the pairs within its budget. A pair is counted in the first block in which it is within budget.

Cells with many vectors are dealt over several tasks by a hash of the vectors' numbers, so none holds an unbounded
group: a part holds at most about PART_VALUES numbers whatever the dimension, and two parts meet once. Tasks return
counts of links and, for the components, a spanning forest of the links of each tile, never all pairs. Equal vectors are
compared once; they are told by 128 bits of hash, and numbered.

Vectors that are null, empty, zero or hold a null, NaN or infinity link with nothing; so do vectors of
different length. An empty table gives an empty result. Repeated ids: each row counts as a vector of its own; results
are per id and vector. Only vec_id and embedding are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, written
from .components import components

BLOCKS, GRID = 4, 1
#: Numbers (vectors times dimensions) of a part of a cell, two of which meet in a task's group, and vectors of a step in numpy.
PART_VALUES, TILE = 1 << 21, 512
SEED, SLACK = 17, 1e-5


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def cuts(d: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return list(zip(edges[:-1], edges[1:], strict=True))


def cells(vectors: DataFrame, least: float) -> DataFrame:
    """(d, block, cell, home, node, weight, embedding): each vector at home and in the later cells in its reach, in every block."""
    limit = 2 * (1 - least) + 1e-9
    kind = pa.float32() if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else pa.float64()

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            for d in np.unique(sizes):
                which = pa.array(np.flatnonzero(sizes == d))
                rows = batch.take(which)
                v = rows.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, d)
                turned = v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(d).T
                for b, (lo, hi) in enumerate(cuts(d)):
                    reach = max(np.sqrt(limit * (hi - lo) / d), 1e-3)
                    own = turned[:, lo : min(lo + GRID, hi)]
                    place = np.floor(own / reach).astype(np.int64)
                    moves = np.stack(np.meshgrid(*[[-1, 0, 1]] * own.shape[1], indexing="ij"), -1).reshape(-1, own.shape[1])
                    for move in moves[len(moves) // 2 :]:  # staying and, of each two opposite moves, the later one
                        gap = np.where(move > 0, (place + 1) * reach - own, np.where(move < 0, own - place * reach, 0.0))
                        into = pa.array(np.flatnonzero((gap * gap).sum(1) <= reach * reach))
                        part, to = rows.take(into), (place + move)[into.to_numpy()]
                        cell = sum(to[:, k] * 4096**k for k in range(to.shape[1]))
                        n = len(into)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int64)), pa.array(np.full(n, b, np.int64)), pa.array(cell), pa.array(np.full(n, not move.any())), part.column("node"), part.column("weight"), part.column("embedding").cast(pa.list_(kind))], names=["d", "block", "cell", "home", "node", "weight", "embedding"])

        return step

    element = "float" if kind == pa.float32() else "double"
    return by_batch(vectors.select("node", "weight", "embedding"), f"d long, block long, cell long, home boolean, node long, weight long, embedding array<{element}>", make)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join two trees so far: enough of them for the components of the tile."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            out[k] = True
    return out


def compare(left: pd.DataFrame, right: pd.DataFrame, least: float, b: int, same: bool) -> pd.DataFrame:
    """Counts and a forest of the links in block b between two parts, or (same) within one."""
    empty = pd.DataFrame({"node": np.zeros(0, np.int64), "to": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return empty
    x, y = (np.stack(side["embedding"].to_numpy()).astype(np.float64) for side in (left, right))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    nx, ny = left["node"].to_numpy(), right["node"].to_numpy()
    wx, wy = left["weight"].to_numpy(), right["weight"].to_numpy()
    d = x.shape[1]
    limit = 2 * (1 - least) + 1e-9
    spans = cuts(d)
    q = rotation(d).T
    tx, ty = x @ q, y @ q
    lo, hi = spans[b]
    # -distance^2 / 2 in the block as one product in single precision; SLACK covers its rounding, and what passes is checked in double.
    lift = lambda v, own: np.column_stack([v[:, lo:hi], -0.5 * (v[:, lo:hi] ** 2).sum(1), np.ones(len(v))] if own else [v[:, lo:hi], np.ones(len(v)), -0.5 * (v[:, lo:hi] ** 2).sum(1)]).astype(np.float32)
    p, r = lift(tx, True), lift(ty, False).T.copy()
    found_a, found_b = [], []
    for k in range(0, len(x), TILE):
        for m in range(k if same else 0, len(y), TILE):
            near = np.flatnonzero(p[k : k + TILE] @ r[:, m : m + TILE] >= -0.5 * limit * (hi - lo) / d - SLACK)
            wide = min(TILE, len(y) - m)
            i, j = k + near // wide, m + near % wide
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = (x[u] * y[v]).sum(1) >= least
                u, v = u[ok], v[ok]
                diff = (tx[u] - ty[v]) ** 2
                first = diff[:, lo:hi].sum(1) <= limit * (hi - lo) / d
                for e, f in spans[:b]:
                    first &= diff[:, e:f].sum(1) > limit * (f - e) / d
                found_a.append(u[first])
                found_b.append(v[first])
    if not found_a:
        return empty
    a, c = np.concatenate(found_a), np.concatenate(found_b)
    node = np.concatenate([nx, ny])
    n = np.bincount(a, weights=wy[c], minlength=len(nx)), np.bincount(c, weights=wx[a], minlength=len(ny))
    count = np.concatenate(n).astype(np.int64)
    tree = forest(nx[a], ny[c])
    return pd.concat([pd.DataFrame({"node": node[count > 0], "to": count[count > 0], "other": -1}), pd.DataFrame({"node": nx[a][tree], "to": 0, "other": ny[c][tree]})])


def link_parts(placed: DataFrame, least: float) -> DataFrame:
    """(node, to, other): either a count of links (other -1) or a link of a spanning forest. placed: as from cells."""
    parts = lambda n: F.ceil(n * F.col("d") / PART_VALUES).cast("int")
    size = placed.groupBy("d", "block", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v")).where("h > 0")
    size = size.select("d", "block", "cell", parts(F.col("h")).alias("hp"), parts(F.col("v")).alias("vp"))
    dealt = placed.join(size, ["d", "block", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("hp")).otherwise(F.col("vp"))).cast("int"))
    to = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda k: k < F.col(n))
    group = lambda visit, i, j, left: F.struct(F.lit(visit).alias("visit"), i.alias("i"), j.alias("j"), left.alias("left"))
    own = F.col("own")
    home = F.concat(F.transform(to("hp"), lambda k: group(False, F.least(own, k), F.greatest(own, k), own <= k)), F.transform(to("vp"), lambda k: group(True, own, k, F.lit(True))))
    visitor = F.transform(to("hp"), lambda k: group(True, k, own, F.lit(False)))
    met = dealt.select("d", "block", "cell", "node", "weight", "embedding", F.explode(F.when(F.col("home"), home).otherwise(visitor)).alias("g"))
    met = met.select("d", "block", "cell", "g.visit", "g.i", "g.j", "g.left", "node", "weight", "embedding")

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, block, _, visit, i, j = key
        same = not visit and i == j
        return compare(rows[rows["left"]], rows if same else rows[~rows["left"]], least, int(block), same)

    return met.groupBy("d", "block", "cell", "visit", "i", "j").applyInPandas(tile, "node long, to long, other long")


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding), which is read twice."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.coalesce(F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists("embedding", lambda e: e != 0), F.lit(False))
    plain = F.transform("embedding", lambda e: e + 0.0)  # -0.0 as 0.0
    x = x.withColumn("bad", bad)
    keyed = x.where("not bad").withColumn("h", F.xxhash64(plain)).withColumn("g", F.xxhash64(F.lit(SEED), plain))
    groups = keyed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    with Scratch(vectors.sparkSession) as space:
        # The numbers are fixed by writing them.
        groups = space.written(groups.withColumn("node", F.monotonically_increasing_id()))
        placed = space.written(cells(groups, least))
        found = space.written(link_parts(placed, least))
        counts = found.where("to > 0").groupBy("node").agg(F.sum("to").alias("to"))
        roots = components(found.where("to = 0"), "node", "other")
        named = groups.select("h", "g", "node", "rep", "weight").join(counts, "node", "left").join(roots, "node", "left")
        named = named.select("h", "g", "rep", (F.coalesce("to", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
        smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = written(named.join(smallest, "root").select("h", "g", "n_links", "component_id"))
    # Rows that link with nothing stay out of the join, so that they are no hot key.
    alone = x.where("bad").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keyed.select("vec_id", "h", "g").join(named, ["h", "g"], "left").select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

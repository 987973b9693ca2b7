"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are documents, columns are word n-grams; texts with equal n-gram sets are one row. The
product of the matrix with its transpose holds the overlap of every two rows. It is taken tile by tile in tasks:
the overlaps of a tile are accumulated over blocks of columns, and after each block the pairs are
discarded whose overlap so far, with what is left of the smaller set, cannot reach t / (1 + t) of both
sizes; pairs of which the smaller set holds less than t times the larger are discarded at once. A task returns a
spanning forest of the links that it finds, never a row for each pair.

Only rows that can link meet in a tile. With n-grams in one global order, a set of n that links with another
shares at least s of its first n - ceil(t n) + s n-grams with it, for any s up to ceil(t n). So
a row stays only if as many of its first columns are held by others (s grows with n, see `least_shared`), and two
rows meet only if they share one of these columns. Columns come rarest first: n-grams seen often (counted in
all documents, within windows of texts) are moved to the end of the order, so that passages which many
documents share bring no rows together. Any order gives the same result; the order only sets the work.

Each column names one of its rows as its pivot, and the rows of all columns with one pivot are a bundle: near copies share most
columns, so a row is in few bundles. Small bundles are dealt to tiles of about BUCKET_GRAMS n-grams. A
bundle over PART rows or PART_GRAMS n-grams is split in parts: first every part meets the pivot, and only where its rows are
then still in several components, every two parts meet in a tile, in which only rows of different components are
compared. The result is exact: no pair that could link two components is left out.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer words than n has its whole word sequence as one
n-gram; null, empty and blank texts have no n-gram and link with nothing. n-grams are compared by 64-bit hashes,
sets by 128-bit ones. Repeated rows and rows with the same id are separate rows of one class. A text of any length is one row
of the matrix. An empty table gives an empty result. Only doc_id and text are read; `keep_one` passes other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch, by_batch, listed, row_hash, written
from .components import components
from .textarrays import Words, mix, text_slices

#: How many frequent n-grams are moved to the end of the order at most (their list goes to every task), and how often they must have been met.
FREQUENT, OFTEN = 1 << 17, 8
#: Of n n-grams at least n / SHARED + 2 (or all that a link needs) must be among the first columns of a row that links.
SHARED = 10
#: A bundle of more rows or n-grams is split in parts; n-grams of a tile of small bundles; columns of a block of the product.
PART, PART_GRAMS, BUCKET_GRAMS, COLUMNS = 1024, 1 << 20, 1 << 18, 4096


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text."""
    w = Words(texts, lower=True)
    h, k = w.hashes, np.uint64(0x9FB21C651E98DF25)
    gram = h.copy()
    for i in range(1, n):
        gram[: len(h) - i] = gram[: len(h) - i] * k + h[i:] if len(h) > i else gram[:0]
    gram = mix(gram[: max(len(h) - n + 1, 0)] ^ k)
    out = []
    for a, b in zip(w.word_offsets[:-1], w.word_offsets[1:], strict=True):
        if b - a >= n:
            x = np.sort(gram[a : b - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix((np.array([whole]) ^ x) * k)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(x: np.ndarray) -> bytes:
    """128 bits that name a set of n-grams; empty for the empty set."""
    if not len(x):
        return b""
    a = np.bitwise_xor.reduce(mix(x + np.uint64(len(x))))
    b = np.add.reduce(mix(x * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.array([a, b], np.uint64).tobytes()


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank by count) of at most FREQUENT n-grams that many different sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["gram", "c"])

        size = 0
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                for x in shingle_sets(texts, n):
                    key = set_key(x)
                    if key not in seen:
                        seen.add(key)
                        held.append(x)
                        size += len(x)
                if size > 1_500_000:
                    yield rows()
                    size = 0
        yield rows()

    counts = docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "gram").limit(FREQUENT).toArrow()
    gram, c = (top.column(k).to_numpy() for k in ("gram", "c"))
    order = np.argsort(gram.view(np.uint64))
    return gram.view(np.uint64)[order], c[order]


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n needs at least with any set that it links with."""
    return -(-percent * n // 100)


def least_shared(n: int, percent: int) -> int:
    return min(needed(n, percent), -(-n // SHARED) + 2)


def first_columns(x: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The n-grams of a set that come first in the global order: a linked set has least_shared of them among its own first ones."""
    size = len(x) - needed(len(x), percent) + least_shared(len(x), percent)
    gram, rank = frequent
    if len(gram) and len(x):
        at = np.minimum(np.searchsorted(gram, x), len(gram) - 1)
        x = x[np.lexsort((x, np.where(gram[at] == x, rank[at], 0)))]
    return x[:size]


def class_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, h, n_shingles, key, short, first) for every row of docs; first only where a task meets a set for the first time.

    short is half of the key: it names rows of the matrix until candidates are known."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def make():
        seen: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts, n)
                keys = [set_key(x) for x in sets]
                columns = []
                for key, x in zip(keys, sets, strict=True):
                    columns.append(None if key in seen else first_columns(x, shared.value, percent).view(np.int64))
                    seen.add(key)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pa.array(columns, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "key", "short", "first"])

        return step

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("h")), "doc_id long, h long, n_shingles long, key binary, short long, first array<long>", make)


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(key, grams): the sorted n-gram hashes of each set, once in a task."""

    def make():
        seen: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, texts in text_slices(batch.column("text")):
                sets = {set_key(x): x for x in shingle_sets(texts, n)}
                new = [k for k in sets if k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([sets[k].tobytes() for k in new], pa.binary())], names=["key", "grams"])

        return step

    return by_batch(docs.select("text"), "key binary, grams binary", make)


def overlapping(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) of a tile: of rows where left with the other rows, or, if all are, among themselves; rows with one label don't meet."""
    n = np.array([len(x) for x in sets], np.int64)
    ours = np.flatnonzero(left)
    theirs = ours if left.all() else np.flatnonzero(~left)
    side = lambda x: (x[ours][:, None], x[theirs][None, :])
    (na, nb), (la, lb) = side(n), side(labels)
    need = -(-percent * (na + nb) // (100 + percent))
    alive = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (la != lb)
    if ours is theirs:
        alive &= ours[:, None] < theirs[None, :]
    # Columns that only one row holds add to no overlap; the others are numbered rarest first.
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    common = count[column] > 1
    column, row = column[common], row[common]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    column = rank[column] - int((count < 2).sum())
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    rest = np.bincount(row, minlength=len(n))
    same = np.zeros(alive.shape, np.int64)
    for start in range(0, int((count > 1).sum()) + 1, COLUMNS):
        alive &= same + np.minimum(*side(rest)) >= need
        if not alive.any():
            break
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        a, b = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        same[np.ix_(a, b)] += np.rint(incidence(row[lo:hi], column[lo:hi] - start, ours[a], len(n)) @ incidence(row[lo:hi], column[lo:hi] - start, theirs[b], len(n)).T).astype(np.int64)
        rest = rest - np.bincount(row[lo:hi], minlength=len(n))
    a, b = np.nonzero(alive & (same >= need))
    return ours[a], theirs[b]


def incidence(row: np.ndarray, column: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """A block of the matrix: the given rows of n, and COLUMNS columns at most."""
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    held = place[row] >= 0
    out = np.zeros((len(rows), int(column.max()) + 1 if len(column) else 0), np.float32)
    out[place[row[held]], column[held]] = 1
    return out


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first row of each component of the links (a, b) of n rows to its other rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(n))
    return label[other], other


def tile_links(tile: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links in each bundle of a tile."""
    bundle = tile["bundle"].to_numpy()
    order = np.argsort(bundle, kind="stable")
    bundle, ids, label, left = (tile[c].to_numpy()[order] for c in ("bundle", "id", "label", "left"))
    grams = tile["grams"].combine_chunks()
    edge = np.flatnonzero(np.concatenate([[True], bundle[1:] != bundle[:-1], [True]]))
    found = []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        if hi - lo > 1 and left[lo:hi].any():
            sets = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in order[lo:hi]]
            a, b = spanning(*overlapping(sets, label[lo:hi], left[lo:hi], percent), hi - lo)
            found.append((ids[lo + a], ids[lo + b]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def linked(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that give the components of all tiles. rows: (tile, i, j, bundle, id, key, label, left)."""
    return rows.join(sets, "key").drop("key").groupBy("tile", "i", "j").applyInArrow(lambda t: tile_links(t, percent), "a long, b long")


def bundles(space: Scratch, table: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(bundle, short, n): the rows that share a first column, by the pivot of the column."""
    entries = table.where("first is not null").select("short", F.explode("first").alias("gram"))
    # What is joined is written before, so that Spark can split a column that very many rows hold.
    often = space.written(entries.groupBy("gram").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo <> hi").select("gram"))
    shared = space.written(entries.join(often, "gram").distinct())
    need = F.ceil(F.col("n") * percent / 100)
    least = F.least(F.ceil(need * percent / 100), F.ceil(need / SHARED) + 2)  # what the smallest set that can link must share
    able = space.written(shared.groupBy("short").agg(F.count(F.lit(1)).alias("c")).join(classes.select("short", "n"), "short").where(F.col("c") >= least).select("short", "n"))
    shared = space.written(shared.join(able, "short"))
    pivots = space.written(shared.groupBy("gram").agg(F.min(F.struct(F.xxhash64("short").alias("p"), "short"))["short"].alias("bundle"), F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "bundle"))
    member = shared.join(pivots, "gram").select("bundle", "short", "n").distinct()
    # A row stays only if the bundle has another whose size is near enough: bands of sizes are so wide that linked sets are in neighbouring ones.
    member = space.written(member.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)))
    near = member.select("bundle", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band")).groupBy("bundle", "band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bundle", "band")
    return space.written(member.join(space.written(near), ["bundle", "band"]).drop("band"))


def class_links(space: Scratch, docs: DataFrame, table: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between class ids that give the components."""
    member = bundles(space, table, classes, percent)
    sized = space.written(member.groupBy("bundle").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams")).withColumn("parts", F.ceil(F.greatest(F.col("rows") / PART, F.col("grams") / PART_GRAMS)).cast("int")))
    buckets = -(-(sized.where("parts = 1").agg(F.sum("grams")).first()[0] or 1) // BUCKET_GRAMS)

    # The sets of all rows that are in a bundle, from the text of one document of each class.
    wanted = space.written(classes.join(member.select("short").distinct(), "short").select("id", "short", "key", "rep"))
    reps = wanted.select(F.col("rep").alias("__rep")).distinct()
    if reps.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS:
        reps = F.broadcast(reps)  # else the texts are shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(reps, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    sets = full_sets(texts, n).dropDuplicates(["key"])

    placed = space.written(member.join(sized, "bundle").join(wanted.select("short", "id", "key"), "short").select("bundle", "id", "key", (F.col("short") == F.col("bundle")).alias("pivot"), "parts"))
    small = placed.where("parts = 1").select(F.lit(-1).cast("long").alias("tile"), F.pmod(F.xxhash64("bundle"), F.lit(buckets)).alias("i"), F.lit(0).alias("j"), "bundle", "id", "key", F.col("id").alias("label"), F.lit(True).alias("left"))
    large = placed.where("parts > 1").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    star = large.where("not pivot").select(F.col("bundle").alias("tile"), F.col("own").cast("long").alias("i"), F.lit(0).alias("j"), "bundle", "id", "key", F.col("id").alias("label"), F.lit(False).alias("left"))
    centre = large.where("pivot").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("bundle").alias("tile"), F.col("p").cast("long").alias("i"), F.lit(0).alias("j"), "bundle", "id", "key", F.col("id").alias("label"), F.lit(True).alias("left"))
    links = space.written(linked(small.union(star).union(centre), sets, percent))

    if large.isEmpty():
        return links
    root = components(links).withColumnRenamed("node", "id")
    marked = space.written(large.join(root, "id", "left").select("bundle", "id", "key", "parts", "own", F.coalesce("root", "id").alias("label")))
    several = space.written(marked.groupBy("bundle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bundle"))
    marked = marked.join(several, "bundle").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = marked.select(F.col("bundle").alias("tile"), F.least("own", "p").cast("long").alias("i"), F.greatest("own", "p").alias("j"), "bundle", "id", "key", "label", (F.col("own") <= F.col("p")).alias("left"))
    return links.union(space.written(linked(rows, sets, percent)))


def classified(space: Scratch, docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, key) for every row of docs, and (key, component_id, label) for every set that is not empty."""
    table = space.written(class_table(docs, n, percent))
    classes = table.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("short").alias("short"))
    classes = space.written(classes.withColumn("id", F.monotonically_increasing_id()))
    root = components(class_links(space, docs, table, classes, n, percent)).withColumnRenamed("node", "id")
    slim = classes.select("key", "rep", "id")
    smallest = space.written(slim.join(root, "id").groupBy("root").agg(F.min("rep").alias("least")))
    named = slim.join(root, "id", "left").join(smallest, "root", "left")
    return table.drop("short", "first"), space.written(named.select("key", F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "id").alias("label")))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, key, component_id, label) for every row of docs; rows link when 100 |A and B| >= percent |A or B|.

    label names the component also where all its ids are null; it is null for rows without n-grams."""
    with Scratch(docs.sparkSession) as space:
        table, classes = classified(space, docs, n, percent)
        out = table.join(classes, "key", "left")
        return written(out.select("doc_id", "n_shingles", "key", "label", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; rows without n-grams all
    stay. Rows with the same id and text count once; of rows with the smallest id and other texts, one stays. Null ids come last."""
    with Scratch(docs.sparkSession) as space:
        table, classes = classified(space, docs, n, percent)
        rows = space.written(table.join(classes.select("key", "label"), "key", "left").select("doc_id", "h", "label"))
        kept = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("m"))
        kept = space.written(kept.select("m.doc_id", "m.h"))
        same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.h == b.h)
        out = rows.where("label is not null")
        out = written(out.join(kept, same(out, kept), "left_anti").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct())
        twice = written(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")))
    left = listed(docs, out, "left_anti")
    if twice.isEmpty():
        return left
    names = docs.columns
    once = listed(left, twice, "left_semi").withColumn("__row", row_hash()).dropDuplicates(["doc_id", "__row"]).select(*names)
    return listed(left, twice, "left_anti").union(once)

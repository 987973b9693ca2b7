"""Seed and verify: sequences of two sets that share a k-mer, compared at the shift that the k-mer fixes.

No join carries a whole sequence. Seeds are (id, place, k-mer, base before); a pair of seeds counts only where the bases before
differ, so that a run of shared k-mers gives one candidate and not one for each k-mer. k-mers that are frequent on a side are
dealt over tiles: each side's places are cut into parts of about TILE, and every part meets every part of the other side under a key of its own.
Candidates are compared piece by piece: the subject is a store of blocks of 2 * PIECE bases, one every PIECE, the query one of
pieces of PIECE, and a candidate's piece joins one block and one piece. Equal and unequal bases are added up at the end, so a task
holds pieces, whatever the lengths of the sequences.

Where one side is small (HELD bases), as reads on contigs are, it is broadcast, and each row of the other side finds its seeds, compares and counts within its task: nothing is
shuffled. A long sequence is looked at in parts; a candidate belongs to the part that it starts in, so it is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import windows

PIECE = 256
TILE = 2048
#: Frequent k-mers are broadcast up to this number, and joined beyond it.
LISTED = 100_000
START = "^"
#: A side of at most this many bases and sequences is broadcast.
HELD, HELD_ROWS = 1 << 22, 1 << 17
#: Starts of candidates that a part of a long sequence has at least, and pairs of windows or bases that are looked at together.
PART, STEP = 1 << 20, 1 << 22


def seeds(sequences: DataFrame, ids: list[str], k: int) -> DataFrame:
    """(*ids, size, place, kmer, before): all k-mers of sequences (*ids, s), with the base before each."""
    longer = S.kmers(F.concat(F.lit(START), "s"), k + 1)
    # The length is taken before the array is exploded; else every row would carry the sequence.
    found = sequences.select(*ids, F.length("s").alias("size"), longer.alias("all")).select(*ids, "size", F.posexplode("all").alias("place", "x"))
    return found.select(*ids, "size", "place", F.substr("x", F.lit(2), F.lit(k)).alias("kmer"), F.substr("x", F.lit(1), F.lit(1)).alias("before"))


def tiled(a: DataFrame, b: DataFrame, a_ids: list[str], b_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' seeds with (ta, tb), the tile in which they meet; (0, 0) but for k-mers that are frequent on a side."""
    count = lambda x, name: x.groupBy("kmer").agg(F.count(F.lit(1)).alias(name))
    parts = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    often = count(a, "na").join(count(b, "nb"), "kmer").where((F.col("na") > TILE) | (F.col("nb") > TILE)).select("kmer", parts("na").alias("pa"), parts("nb").alias("pb"))
    if often.limit(LISTED + 1).count() <= LISTED:
        often = F.broadcast(often)

    def deal(x: DataFrame, ids: list[str], own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        y = x.join(often, "kmer", "left").withColumn(own, F.coalesce(F.pmod(F.hash(*ids, "place"), F.col(own_parts)), F.lit(0)))
        return y.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_parts), F.lit(1)) - 1))).drop("pa", "pb")

    return deal(a, a_ids, "ta", "pa", "tb", "pb"), deal(b, b_ids, "tb", "pb", "ta", "pa")


def candidates(a: DataFrame, b: DataFrame, a_ids: list[str], b_ids: list[str], k: int, where: Column | str) -> DataFrame:
    """Distinct (*a_ids, *b_ids, na, nb, d): b starts d bases into a, and they share a k-mer there. na, nb: lengths."""
    sa, sb = tiled(seeds(a, a_ids, k), seeds(b, b_ids, k), a_ids, b_ids)
    sa = sa.withColumnsRenamed({"size": "na", "place": "pa", "before": "xa"})
    sb = sb.withColumnsRenamed({"size": "nb", "place": "pb", "before": "xb"})
    pairs = sa.join(sb, ["kmer", "ta", "tb"]).where((F.col("xa") != F.col("xb")) | (F.col("xa") == START))
    return pairs.select(*a_ids, *b_ids, "na", "nb", (F.col("pa") - F.col("pb")).alias("d")).where(where).distinct()


def compared(found: DataFrame, a: DataFrame, b: DataFrame, a_ids: list[str], b_ids: list[str]) -> DataFrame:
    """candidates with `match` and `mismatch`, the equal and unequal bases where both sequences are."""
    first = F.greatest(F.floor(-F.col("d") / PIECE), F.lit(0))  # the query's first piece that reaches into the subject
    last = F.floor((F.least(F.col("nb"), F.col("na") - F.col("d")) - 1) / PIECE)
    start = F.greatest(F.col("d") + F.col("piece") * PIECE, F.lit(0))
    end = F.least(F.col("d") + F.least((F.col("piece") + 1) * PIECE, F.col("nb")), F.col("na"))
    parts = found.select(*found.columns, F.explode(F.sequence(first, last)).alias("piece"))
    parts = parts.select(*found.columns, "piece", start.alias("at"), (end - start).cast("int").alias("n")).where("n > 0")
    parts = parts.withColumn("block", F.floor(F.col("at") / PIECE).cast("int")).withColumn("piece", F.col("piece").cast("int"))
    blocks = a.select(*a_ids, F.posexplode(S.pieces(F.col("s"), PIECE, 2 * PIECE)).alias("block", "text"))
    pieces = b.select(*b_ids, F.posexplode(S.pieces(F.col("s"), PIECE, PIECE)).alias("piece", "text"))
    cut = lambda offset: F.substr("text", (offset + 1).cast("int"), F.col("n"))
    here = parts.join(blocks, [*a_ids, "block"]).withColumn("x", cut(F.col("at") - F.col("block") * PIECE)).drop("text", "block")
    both = here.join(pieces, [*b_ids, "piece"]).withColumn("y", cut(F.col("at") - F.col("d") - F.col("piece") * PIECE))
    wrong = both.select(*found.columns, "n", S.differing(F.col("x"), F.col("y")).alias("w"))
    return wrong.groupBy(*found.columns).agg(F.sum(F.col("n") - F.col("w")).alias("match"), F.sum("w").alias("mismatch"))


class Held:
    """The windows of the broadcast side: codes over its own characters, sorted, with the sequence, place and character before of each."""

    def __init__(self, rows: pa.Table, k: int) -> None:
        self.rows, self.k = rows.drop_columns("s").combine_chunks(), k
        values, self.starts = windows.characters(rows.column("s").combine_chunks())
        letters = np.unique(values)
        self.bits = len(letters).bit_length()
        self.fits = self.bits * k <= 64
        self.number = np.zeros(0x110000, np.uint8)  # 0: a character that no sequence here has
        self.number[letters] = np.arange(1, len(letters) + 1) if self.fits else 0
        self.values = self.number[values]
        row, at = windows.places(self.starts, k)
        code = windows.sliding(self.values, k, self.bits)[at] if self.fits else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        code, at, row = code[order], at[order], row[order]
        self.row, self.place = row, at - self.starts[row]
        self.before = np.where(self.place > 0, self.values[np.maximum(at, 1) - 1], 0) if self.fits else code
        self.first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        self.code, self.n = code[self.first], np.diff(np.append(self.first, len(code)))
        self.longest = int(np.diff(self.starts).max(initial=0))

    def found(self, values: np.ndarray, lo: int, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, d) of candidates on the text of `size` characters from `lo` on whose d lies in first..last - 1, each once."""
        begin, end = max(first, 0), min(max(last, 0) + self.longest, size)
        code = windows.sliding(values[lo + begin : lo + end], self.k, self.bits)
        if not len(code) or not len(self.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        at = np.flatnonzero(self.code[which] == code)
        which = which[at]
        n, span = self.n[which], last - first
        keys = np.zeros(0, np.int64)
        total = np.cumsum(n)
        cut = 0
        while cut < len(at):
            to = max(int(np.searchsorted(total, (total[cut - 1] if cut else 0) + STEP, side="right")), cut + 1)
            m = n[cut:to]
            mine = np.repeat(self.first[which[cut:to]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            place = np.repeat(at[cut:to], m) + begin
            d = place - self.place[mine]
            start = place == 0
            apart = start | (self.place[mine] == 0) | (values[lo + place - 1 + start] != self.before[mine])
            ok = apart & (d >= first) & (d < last)
            keys = np.unique(np.concatenate([keys, self.row[mine[ok]] * span + (d[ok] - first)]))
            cut = to
        return keys // span, keys % span + first

    def compared(self, values: np.ndarray, at: np.ndarray, mine: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many of n characters from `at` on equal those from `mine` on."""
        same, total, cut = np.zeros(len(n), np.int64), np.cumsum(n), 0
        while cut < len(n):
            to = max(int(np.searchsorted(total, (total[cut - 1] if cut else 0) + STEP, side="right")), cut + 1)
            m = n[cut:to]
            before = np.cumsum(m) - m
            k = np.arange(int(m.sum()))
            equal = values[np.repeat(at[cut:to] - before, m) + k] == self.values[np.repeat(mine[cut:to] - before, m) + k]
            same[cut:to] = np.add.reduceat(equal, before, dtype=np.int64)
            cut = to
        return same


def held(b: DataFrame, b_ids: list[str], k: int) -> Held | None:
    """b, if it is small enough to be broadcast."""
    n, bases = b.select("s").where(F.length("s") >= k).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("s")), F.lit(0))).first()
    if n > HELD_ROWS or bases > HELD:
        return None
    side = Held(b.select(*b_ids, "s").where(F.length("s") >= k).toArrow(), k)
    return side if side.fits else None


def nearby(a: DataFrame, a_ids: list[str], b_ids: list[str], b: DataFrame, side: Held, where: Column | str) -> DataFrame:
    """seeded with the broadcast side."""
    shared = a.sparkSession.sparkContext.broadcast(side)
    names = [*a_ids, *b_ids, "na", "nb", "d", "match", "mismatch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = max(PART, own.longest)

        def rows(part: pa.RecordBatch, row: list, mine: list, d: list, values: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            row, mine, d = (np.concatenate(x) for x in (row, mine, d))
            na, nb = np.diff(starts)[row], np.diff(own.starts)[mine]
            low, high = np.maximum(d, 0), np.minimum(d + nb, na)
            same = own.compared(values, starts[row] + low, own.starts[mine] + low - d, high - low)
            ids = [part.column(i).take(pa.array(row)) for i in a_ids]
            other = [own.rows.column(i).combine_chunks().take(pa.array(mine)) for i in b_ids]
            numbers = [pa.array(x.astype(np.int32)) for x in (na, nb, d)]
            return pa.RecordBatch.from_arrays([*ids, *other, *numbers, pa.array(same), pa.array(high - low - same)], names=names)

        for batch in batches:
            for part in windows.slices(batch):
                values, starts = windows.characters(part.column("s"))
                values = own.number[values]
                row, mine, d, size = [], [], [], 0
                for r, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    cuts = [-own.longest, *range(width, hi - lo, width), max(hi - lo, 1)]
                    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                        m, at = own.found(values, lo, hi - lo, first, last)
                        row.append(np.full(len(m), r))
                        mine.append(m)
                        d.append(at)
                        size += len(m)
                        if size > STEP >> 4:
                            yield rows(part, row, mine, d, values, starts)
                            row, mine, d, size = [], [], [], 0
                if size:
                    yield rows(part, row, mine, d, values, starts)

    kinds = windows.columns(a, a_ids) + windows.columns(b, b_ids)
    return a.select(*a_ids, "s").mapInArrow(run, f"{kinds}na int, nb int, d int, match long, mismatch long").where(where)


def seeded(a: DataFrame, b: DataFrame, a_ids: list[str], b_ids: list[str], k: int, where: Column | str = "true") -> DataFrame:
    """(*a_ids, *b_ids, na, nb, d, match, mismatch) of all pairs and shifts with a shared k-mer. where: on ids, na, nb and d, before anything is compared on the shuffled way."""
    side = held(b, b_ids, k)
    return nearby(a, a_ids, b_ids, b, side, where) if side else compared(candidates(a, b, a_ids, b_ids, k, where), a, b, a_ids, b_ids)

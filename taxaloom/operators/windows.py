"""Windows of sequences, read in numpy from Arrow batches: codes of k neighbouring characters, those that a set of k-mers may hold, and their pairs with the opposite strand.

A window of A, C, G and T is a number of two bits a base; windows with other characters are rare and are handled as strings, so every result is that of the strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a task looks at together; a longer sequence is looked at by itself.
CHARS = 1 << 21
#: Sizes of the bit tables of known k-mers, at most 16 MB; a small table holds several k-mers in one bit, which only lets more windows pass.
SLOTS = (1_048_573, 16_777_213, 134_217_689)
#: Bases of a code, so that its sign is free.
LONGEST = 31
DIGIT = np.full(256, 4, np.uint8)
DIGIT[list(b"ACGT")] = range(4)
BACK = str.maketrans("ACGTN", "TGCAN")


def opposite(kmer: Column) -> Column:
    """The other k-mer of a canonical pair."""
    return F.reverse(F.translate(kmer, "ACGTN", "TGCAN"))


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each text starts (one place more than texts); null is empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    if len(values) and values.max() > 127:
        starts = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])
        return np.frombuffer(values.tobytes().decode().encode("utf-32-le"), np.uint32), starts.astype(np.int64)
    return values, offsets - offsets[0]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about CHARS bytes in column s."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("s")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(total // CHARS)) + 1, [len(total)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(lo, hi - lo)


def sliding(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The numbers that every k neighbours of x make, of `bits` bits each, the first in the highest place."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    out, have, p, size = None, 0, x.astype(np.uint64), 1
    while size <= k:
        if k & size:
            n = len(x) - have - size + 1
            out = p[:n] if out is None else (out[:n] << np.uint64(bits * size)) | p[have : have + n]
            have += size
        if 2 * size <= k:
            p = (p[:-size] << np.uint64(bits * size)) | p[size:]
        size *= 2
    return out


def places(starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all windows of k characters that lie within a text; places count from the start of the first text."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(np.arange(len(row)) + k <= starts[1:][row])
    return row[at], at


def spelled(codes: np.ndarray, k: int) -> pa.Array:
    """The strings of codes."""
    shifts = np.arange(2 * k - 2, -2, -2, dtype=np.uint64)
    letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> shifts & np.uint64(3)).astype(np.uint8)]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, (len(codes) + 1) * k, k, dtype=np.int32)), pa.py_buffer(letters.tobytes()))


def text_at(values: np.ndarray, at: int, k: int) -> str:
    return "".join(map(chr, values[at : at + k]))


def _bits(codes: DataFrame, slots: int) -> np.ndarray:
    """A bit at c mod slots for every c of `codes`. At most 16 MB come to the driver."""
    slot = F.pmod("c", F.lit(slots)) + 1
    rows = codes.select(slot.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits")).collect()
    bits = np.zeros(-(-slots // 32768) * 4096, np.uint8)
    for r in rows:
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def known(kmers: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """(bits, slots): a bit at code mod slots for every k-mer of A, C, G and T in `kmers` (column kmer, of k characters). At most 16 MB come to the driver."""
    n = kmers.count()
    slots = next((s for s in SLOTS if s >= 16 * n), SLOTS[-1])
    slots = 4**k if 4**k <= SLOTS[-1] else slots
    held = kmers.where(~F.col("kmer").rlike("[^ACGT]") & (F.length("kmer") == k))
    return _bits(held.select(F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long").alias("c")), slots), slots


def among(codes: np.ndarray, filter_: tuple[np.ndarray, int], k: int) -> np.ndarray:
    bits, slots = filter_
    slot = codes if 4**k <= slots else codes % np.uint64(slots)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def columns(df: DataFrame, ids: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return "".join(f"`{i}` {kinds[i]}, " for i in ids)


def canonical_pairs(sequences: DataFrame, ids: list[str], ks: list[int], near: DataFrame | None = None) -> DataFrame:
    """(*ids, a): the smaller k-mer of each distinct canonical pair of a row's s, for every length of ks, once for a row. near: (kmer), only pairs of which it may
    hold the smaller one; others may come too. Lengths are at most LONGEST."""
    shared = sequences.sparkSession.sparkContext.broadcast({k: known(near, k) for k in ks}) if near is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part: pa.RecordBatch, mine: object, a: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(mine, pa.int64())) for i in ids), a], names=[*ids, "a"])

        for batch in batches:
            for part in slices(batch):
                values, starts = characters(part.column("s"))
                digit = np.where(values < 128, DIGIT[np.minimum(values, 255).astype(np.uint8)], 4)
                strange = np.concatenate([[0], np.cumsum(digit > 3)])
                low = digit & 3
                for k in ks:
                    row, at = places(starts, k)
                    odd = strange[at + k] > strange[at]
                    here, mine = at[~odd], row[~odd]
                    code = np.minimum(sliding(low, k, 2)[here], sliding(3 - low[::-1], k, 2)[::-1][here])
                    if shared is not None:
                        ok = among(code, shared.value[k], k)
                        code, mine = code[ok], mine[ok]
                    if 2 * k + len(part).bit_length() <= 64:
                        both = np.sort(mine.astype(np.uint64) << np.uint64(2 * k) | code)
                        code, mine = both & np.uint64(4**k - 1), (both >> np.uint64(2 * k)).astype(np.int64)
                    else:
                        order = np.lexsort((code, mine))
                        code, mine = code[order], mine[order]
                    new = np.append(True, (code[1:] != code[:-1]) | (mine[1:] != mine[:-1]))[: len(code)]
                    yield rows(part, mine[new], spelled(code[new], k))
                    if odd.any():
                        found = ((r, text_at(values, p, k)) for r, p in zip(row[odd].tolist(), at[odd].tolist(), strict=True))
                        pairs = sorted({(r, min(x, "".join(c if c in "ACGT" else "N" for c in x).translate(BACK)[::-1])) for r, x in found})
                        yield rows(part, [r for r, _ in pairs], pa.array([x for _, x in pairs], pa.string()))

    return sequences.select(*ids, "s").mapInArrow(run, f"{columns(sequences, ids)}a string")


def coded(sequences: DataFrame, ids: list[str], k: int, tail: int) -> DataFrame:
    """(*ids, code, odd): windows of k characters of a row's s, of those with the same last `tail` characters the last one: as numbers, or as strings (odd, else '') where they have other
    characters than A, C, G and T. k is at most LONGEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, starts = characters(part.column("s"))
                digit = np.where(values < 128, DIGIT[np.minimum(values, 255).astype(np.uint8)], 4)
                strange = np.concatenate([[0], np.cumsum(digit > 3)])
                row, at = places(starts, k)
                code = sliding(digit & 3, k, 2)[at].astype(np.int64)
                plain = strange[starts[row + 1]] == strange[starts[row]]
                end = code & (4**tail - 1)
                order = np.lexsort((at[plain], end[plain], row[plain]))
                r, c, e = row[plain][order], code[plain][order], end[plain][order]
                last = np.append((r[1:] != r[:-1]) | (e[1:] != e[:-1]), True)[-len(r) :] if len(r) else np.zeros(0, bool)
                other = {}
                for q, p, n in zip(row[~plain].tolist(), at[~plain].tolist(), code[~plain].tolist(), strict=True):
                    x = text_at(values, p, k)
                    other[q, x[k - tail :]] = (0, x) if strange[p + k] > strange[p] else (n, "")
                mine = np.concatenate([r[last], np.array([q for q, _ in other], np.int64)])
                codes = np.concatenate([c[last], np.array([n for n, _ in other.values()], np.int64)])
                odd = pa.array([""] * int(last.sum()) + [x for _, x in other.values()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(mine)) for i in ids), pa.array(codes), odd], names=[*ids, "code", "odd"])

    return sequences.select(*ids, "s").mapInArrow(run, f"{columns(sequences, ids)}code long, odd string")


def held(sequences: DataFrame, ids: list[str], patterns: DataFrame, kmers: tuple[np.ndarray, int], k: int) -> DataFrame:
    """(*ids, pattern, texts): of the patterns (column pattern, distinct, of k to LONGEST characters) those that an s holds, with the number of rows that do: for every row by itself, or without ids for the
    rows that a task looks at together. kmers: `known` of the last k characters of all patterns. Others that are held may come too."""
    kinds = patterns.groupBy(F.length("pattern").alias("n"), F.col("pattern").rlike("[^ACGT]").alias("odd")).agg(F.count(F.lit(1)).alias("c")).collect()  # a row for each length
    plain, odd = sorted(x.n for x in kinds if not x.odd), sorted(x.n for x in kinds if x.odd)
    n = sum(x.c for x in kinds if not x.odd)
    slots = next((s for s in SLOTS if s >= 16 * n), SLOTS[-1])
    marked = F.conv(F.concat(F.lit("1"), F.translate("pattern", "ACGT", "0123")), 4, 10).cast("long")  # a leading 1 tells the lengths apart
    bits = _bits(patterns.where(~F.col("pattern").rlike("[^ACGT]")).select(marked.alias("c")), slots)
    shared = sequences.sparkSession.sparkContext.broadcast((bits, kmers))
    longest = max(plain, default=k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, near = shared.value

        def rows(part: pa.RecordBatch, mine: np.ndarray, pattern: pa.Array, texts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(mine)) for i in ids), pattern, pa.array(texts)], names=[*ids, "pattern", "texts"])

        for batch in batches:
            for part in slices(batch):
                values, starts = characters(part.column("s"))
                digit = np.where(values < 128, DIGIT[np.minimum(values, 255).astype(np.uint8)], 4).astype(np.uint8)
                row = np.repeat(np.arange(len(part)), np.diff(starts))
                depth = np.arange(len(row)) - starts[row] + 1
                strange = np.concatenate([[0], np.cumsum(digit > 3)])
                clean = depth if not strange[-1] else np.minimum(depth, np.arange(len(row)) - np.maximum.accumulate(np.where(digit > 3, np.arange(len(row)), -1)))
                code = sliding(np.concatenate([np.zeros(longest - 1, np.uint8), digit & 3]), longest, 2)  # of the characters up to each place
                at = np.flatnonzero(clean >= k)
                at = at[among(code[at] & np.uint64(4**k - 1), near, k)]
                code, clean, mine = code[at], clean[at], row[at]
                for size in plain:
                    long = clean >= size
                    c = code[long] & np.uint64(4**size - 1)
                    ok = among(c | np.uint64(4**size), (bits, slots), LONGEST)
                    c, m = c[ok], mine[long][ok]
                    if 2 * size + len(part).bit_length() <= 64:
                        both = np.sort(m.astype(np.uint64) << np.uint64(2 * size) | c)
                        c, m = both & np.uint64(4**size - 1), (both >> np.uint64(2 * size)).astype(np.int64)
                    else:
                        order = np.lexsort((c, m))
                        c, m = c[order], m[order]
                    new = np.append(True, (c[1:] != c[:-1]) | (m[1:] != m[:-1]))[: len(c)]
                    c, m, texts = c[new], m[new], np.ones(int(new.sum()), np.int64)
                    if not ids:
                        c, texts = np.unique(c, return_counts=True)
                    yield rows(part, m, spelled(c, size), texts)
                for size in odd if strange[-1] else []:
                    ends = np.flatnonzero((depth >= size) & (strange[1:] > strange[np.maximum(np.arange(len(row)) - size + 1, 0)]))
                    pairs = sorted({(row[e], text_at(values, e - size + 1, size)) for e in ends.tolist()})
                    yield rows(part, np.array([r for r, _ in pairs], np.int64), pa.array([x for _, x in pairs], pa.string()), np.ones(len(pairs), np.int64))

    return sequences.select(*ids, "s").mapInArrow(run, f"{columns(sequences, ids)}pattern string, texts long")


def counted(sequences: DataFrame, ids: list[str], q: int, slots: list[str]) -> DataFrame:
    """(*ids, n, total): for every row with a window of q characters, how often each q-mer of `slots` or its opposite occurs, in their order, and the number of all windows."""
    slot = np.zeros(4**q, np.int64)
    for i, x in enumerate(slots):
        for y in (x, x.translate(BACK)[::-1]):
            slot[int(y.translate(str.maketrans("ACGT", "0123")), 4)] = i
    most = max((1 << 22) // len(slots), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wide in slices(batch):
                for first in range(0, len(wide), most):
                    part = wide.slice(first, most)
                    values, starts = characters(part.column("s"))
                    digit = np.where(values < 128, DIGIT[np.minimum(values, 255).astype(np.uint8)], 4)
                    strange = np.concatenate([[0], np.cumsum(digit > 3)])
                    row, at = places(starts, q)
                    plain = strange[at + q] == strange[at]
                    n = np.bincount(row[plain] * len(slots) + slot[sliding(digit & 3, q, 2)[at[plain]].astype(np.int64)], minlength=len(part) * len(slots)).reshape(len(part), -1)
                    total = np.maximum(np.diff(starts) - q + 1, 0)
                    mine = np.flatnonzero(total)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(mine) + 1) * len(slots), len(slots), dtype=np.int32)), pa.array(n[mine].ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(mine)) for i in ids), lists, pa.array(total[mine])], names=[*ids, "n", "total"])

    return sequences.select(*ids, "s").mapInArrow(run, f"{columns(sequences, ids)}n array<long>, total long")

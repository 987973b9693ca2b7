"""SentencePiece encoding with sampled segmentations, and lossless decoding.

Pieces and scores come from a public SentencePiece model. A text is cut into segments (a run of
spaces with the run of other characters after it, or one newline) that no piece crosses, so the lattice
over the pieces is a product of small lattices. Forward filtering sums, for each position of
each distinct segment, the weight of all segmentations up to it; backward sampling walks from the end of
each segment and draws each piece by its share of that sum. The draws hash the row key, the seed and
the position in the text, so a row gets the same pieces on every run, in any batch and on any executor.

Scores of a BPE model are merge ranks, not log probabilities; log p is then -log(1 + rank).
`theta` sharpens (above 1) or flattens (below 1) the distribution over segmentations.

Null and empty texts give no pieces and decode to the empty text. Characters outside the piece
inventory, and the mark U+2581 itself, are spelled in byte pieces. Rows with one key and text give equal results. A segment is
never cut, however long. An empty table gives an empty result. An input that has the result's column is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, refuse_clash
from .textarrays import SLICE_CHARS, code_points, mix, span_hashes, text_slices

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "▁"


@dataclass
class Pieces:
    """A trie over the pieces as an open-addressed table of (node, character) keys, with weights and UTF-8 spellings."""

    keys: np.ndarray  # node << 21 | code point, or -1
    children: np.ndarray
    piece_at: np.ndarray  # node -> piece id or -1
    logp: np.ndarray  # piece id -> log weight
    byte_ids: np.ndarray  # byte -> piece id
    spelled: np.ndarray  # UTF-8 of all pieces, one after another
    spelled_at: np.ndarray

    @classmethod
    def load(cls, model_file: str, theta: float = 1.0) -> Pieces:
        """Read the model on the driver; the arrays (about 3 MB for 32,000 pieces) travel to the tasks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ranked = bool(len(plain)) and bool(np.all(scores[plain] == np.round(scores[plain])))
        logp = np.full(n, -np.inf)
        logp[plain] = -np.log1p(scores[plain].max() - scores[plain]) if ranked else scores[plain]
        byte_ids = np.full(256, -1, np.int32)
        spelled: list[bytes] = [b""] * n
        words: dict[str, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:-1], 16)
                byte_ids[b], spelled[i] = i, bytes([b])
        for i in plain:
            piece = sp.id_to_piece(i)
            body = piece.lstrip(MARK)
            if MARK in body or "\n" in body or " " in body:
                continue
            spelled[i] = piece.replace(MARK, " ").encode()
            words.setdefault(piece.replace(MARK, " "), i)
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces; decoding would not be lossless")
        logp[byte_ids] = logp[plain].min() - 2.0
        edges: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for word, i in words.items():
            node = 0
            for ch in word:
                key = (node, ord(ch))
                if key not in edges:
                    edges[key] = len(piece_at)
                    piece_at.append(-1)
                node = edges[key]
            piece_at[node] = i
        table = np.full(1 << (4 * len(edges)).bit_length(), -1, np.int64)
        children = np.zeros(len(table), np.int32)
        for (node, ch), child in edges.items():
            key = node << 21 | ch
            at = cls.slot(np.array([key]), len(table))[0]
            while table[at] >= 0:
                at = (at + 1) % len(table)
            table[at], children[at] = key, child
        at = np.zeros(n + 1, np.int64)
        np.cumsum([len(s) for s in spelled], out=at[1:])
        return cls(table, children, np.array(piece_at, np.int32), logp * theta, byte_ids, np.frombuffer(b"".join(spelled), np.uint8), at)

    @staticmethod
    def slot(key: np.ndarray, size: int) -> np.ndarray:
        return (key * np.int64(0x1E3779B97F4A7C15) >> np.int64(20)) & np.int64(size - 1)

    def child(self, key: np.ndarray) -> np.ndarray:
        """The node below each (node, character) key, or -1."""
        at = self.slot(key, len(self.keys))
        held = self.keys[at]
        out = np.where(held == key, self.children[at], -1).astype(np.int64)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == key[open_]
            out[open_[hit]] = self.children[at[hit]]
            more = ~hit & (held >= 0)
            open_, at = open_[more], at[more]
        return out

    def lattice(self, cp: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (start, end, piece id; -1: spelled in bytes) for all starts; left: characters to the end of the start's segment."""
        starts, ends, ids = [], [], []
        alive = np.arange(len(cp))
        node = np.zeros(len(cp), np.int64)
        single = np.zeros(len(cp), bool)
        step = 0
        while len(alive):
            below = self.child(node << 21 | cp[alive + step].astype(np.int64))
            found = below >= 0
            alive, node = alive[found], below[found]
            step += 1
            piece = self.piece_at[node]
            hit = piece >= 0
            starts.append(alive[hit])
            ends.append(alive[hit] + step)
            ids.append(piece[hit])
            if step == 1:
                single[alive[hit]] = True
            more = left[alive] > step
            alive, node = alive[more], node[more]
        rest = np.flatnonzero(~single)
        return np.concatenate([*starts, rest]), np.concatenate([*ends, rest + 1]), np.concatenate([*ids, np.full(len(rest), -1, np.int32)])


def utf8_length(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)


def segment_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments start: texts, newlines and what follows them, and runs of spaces."""
    n = len(cp)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    newline, space = cp == 10, cp == 32
    cut[:n] |= newline
    cut[1:] |= newline
    cut[1:n] |= space[1:] & ~space[:-1]
    return np.flatnonzero(cut)


class Sampler:
    """Forward filtering and backward sampling for slices of texts."""

    def __init__(self, pieces: Pieces, seed: int) -> None:
        self.p, self.seed = pieces, np.uint64(seed)

    def __call__(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and the offsets of the texts in them. keys: a 64-bit key for each row."""
        cp, offsets = code_points(texts)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        bounds = segment_starts(cp, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        which, first = self._distinct(cp, starts, ends)
        # The distinct segments one after another.
        size = ends[first] - starts[first]
        base = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(base[-1]) - np.repeat(base[:-1], size)
        ucp = cp[np.repeat(starts[first], size) + within]
        edge_start, edge_prob, node_first, edge_piece = self._filter(ucp, np.repeat(size, size) - within, within, base, size)
        # Backward: all occurrences walk from their last position at once.
        doc = np.searchsorted(offsets, starts, side="right") - 1
        row_key = mix(keys.astype(np.uint64) ^ mix(self.seed + np.zeros(1, np.uint64))[0])
        shift = starts - base[which]
        live = np.argsort(which, kind="stable")  # neighbours then read neighbouring edges
        out_from, out_piece, out_doc = [], [], []
        pos = base[which + 1]
        while len(live):
            end = pos[live]
            u = (mix(row_key[doc[live]] + (end + shift[live] - offsets[doc[live]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            # Edges into the position before `end` (node end-1) hold cumulative shares in [end-1, end).
            pick = np.searchsorted(edge_prob, (end - 1) + u, side="right")
            pick = np.clip(pick, node_first[end - 1], node_first[end] - 1)
            begin = edge_start[pick]
            out_from.append(begin + shift[live])
            out_piece.append(edge_piece[pick])
            out_doc.append(doc[live])
            pos[live] = begin
            live = live[begin > base[which[live]]]
        begin, piece, of = np.concatenate(out_from), np.concatenate(out_piece), np.concatenate(out_doc)
        order = np.argsort(begin)
        return self._spell(cp, begin[order], piece[order], of[order], len(texts))

    def _distinct(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of its distinct segment for each segment, and one occurrence of each; compared in full, so equal hashes of unequal segments do no harm."""
        _, first, which = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        same = size == size[first[which]]
        if same.all():
            k = np.repeat(starts, size)
            within = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            if np.array_equal(cp[k + within], cp[np.repeat(starts[first[which]], size) + within]):
                return which, first
        return np.arange(len(starts)), np.arange(len(starts))

    def _filter(self, cp: np.ndarray, left: np.ndarray, within: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges sorted by their end with cumulative shares, and the first edge into each end."""
        start, end, piece = self.p.lattice(cp, left)
        weight = np.where(piece >= 0, self.p.logp[np.maximum(piece, 0)], self.p.logp[self.p.byte_ids[0]] * utf8_length(cp[start]))
        order = np.argsort(end * 64 - np.minimum(end - start, 63), kind="stable")
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        node_first = np.searchsorted(end, np.arange(1, len(cp) + 2))  # edges into position end, by end-1
        # alpha of a position by its distance from the segment's start: all segments advance together.
        done = np.zeros(len(cp))  # log weight of all segmentations up to and with character i
        by_depth = np.argsort(within, kind="stable")
        edges_at = np.searchsorted(within[by_depth], np.arange(int(within.max()) + 2))
        share = np.empty(len(start))
        at_base = within[start] == 0
        for d in range(len(edges_at) - 1):
            last = by_depth[edges_at[d] : edges_at[d + 1]]  # characters that end here
            lo, hi = node_first[last], node_first[last + 1]
            count = hi - lo
            k = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            value = weight[k] + np.where(at_base[k], 0.0, done[start[k] - 1])
            heads = np.cumsum(count) - count
            top = np.repeat(np.maximum.reduceat(value, heads), count)
            grown = np.exp(value - top)
            total = np.add.reduceat(grown, heads)
            done[last] = np.log(total) + top[heads]
            share[k] = grown / np.repeat(total, count)
        run = np.cumsum(share)
        before = np.concatenate([[0.0], run])[node_first[end - 1]]
        # Cumulative share within its end; kept inside [end-1, end) so that one sorted array serves all ends.
        cumulative = np.minimum(run - before, 1 - 1e-12)
        return start, (end - 1) + cumulative, node_first, piece

    def _spell(self, cp: np.ndarray, begin: np.ndarray, piece: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        bytes_at = np.flatnonzero(piece < 0)
        count = np.ones(len(piece), np.int64)
        if len(bytes_at):
            count[bytes_at] = utf8_length(cp[begin[bytes_at]])
        ids = np.repeat(piece, count)
        if len(bytes_at):
            raw = np.frombuffer("".join(map(chr, cp[begin[bytes_at]])).encode("utf-8", "surrogatepass"), np.uint8)
            ids[np.repeat(piece < 0, count)] = self.p.byte_ids[raw]
        sizes = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


def decode_ids(p: Pieces, ids: np.ndarray) -> bytes:
    size = p.spelled_at[ids + 1] - p.spelled_at[ids]
    k = np.repeat(p.spelled_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return p.spelled[k].tobytes()


def encode(df: DataFrame, model_file: str, key: Column, text: str = "text", seed: int = 7, theta: float = 1.0, out: str = "piece_ids") -> DataFrame:
    """All columns of df and `out`, the sampled piece ids of `text`. key: an expression that names the row."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model_file, theta))  # size set by the model's inventory
    keyed = df.withColumn("__key", F.coalesce(F.xxhash64(key), F.lit(0).cast("long")))
    names = df.columns

    def make():
        sample = Sampler(shared.value, seed)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys = batch.column("__key").to_numpy(zero_copy_only=False).view(np.uint64)
            for first, texts in text_slices(batch.column(text), SLICE_CHARS):
                ids, at = sample(texts, keys[first : first + len(texts)])
                part = batch.slice(first, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, out])

        return step

    return by_batch(keyed, _ddl(df, f"{out} array<int>", out), make)


def decode(df: DataFrame, model_file: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """All columns of df and `out`, the text that the piece ids spell; null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model_file))
    names = df.columns

    def make():
        p = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column(ids)
                texts = [decode_ids(p, x.values.to_numpy()).decode("utf-8", "surrogatepass") if x.is_valid and len(x) else "" for x in column]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out])

        return step

    return by_batch(df, _ddl(df, f"{out} string", out), make)


def _ddl(df: DataFrame, extra: str, name: str) -> str:
    refuse_clash(df, name)
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), extra])

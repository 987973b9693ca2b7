"""Alignment of two tokenizers over the same text, and corpus-wide counts of the token pairs that share bytes.

Encoder A is a byte-level BPE (a tokenizers file), encoder B a SentencePiece model; neither is trained here.
Both read the stream, a space and the text. Byte offsets where tokens of both end cut the tokens into groups;
every pair of an A and a B token whose bytes overlap is a link.

The pieces of an alignment form a monoid. A fragment covers a byte range and holds the tokens that end
in it: an open prefix up to its first common end, closed groups, and an open suffix behind its last common
end; without a common end it is all open. Two neighbours join by closing the left suffix with the right prefix
(`joined`), in any bracketing. Texts of more than CHUNK_CHARS characters are cut into byte ranges, which go to
different tasks; fragments are joined FAN at a time, round by round, each round a Spark job over a written table,
and only open ends travel; the closed groups stay where they were found. A range may end inside a word; both
neighbours then encode the word and each keeps the tokens that end in its range. A word of more than STRADDLE
characters on one side of the range's end is not cut.

Words are cut at single spaces between characters that are not white space. No pretoken of A crosses
such a space, and no piece of B holds a mark behind another character (checked on loading), so encoding word by word gives the
tokens of the whole text; a task encodes each different word once for a block of documents. Counts of pairs are added in the
block, then by Spark. The counts of the FREQUENT most frequent pairs are broadcast, all others are joined to the documents that
have them, so nothing that grows with the corpus is broadcast (the best count of each B id is at most one row an id).

Null and empty texts have no tokens: zeros, and the empty string as digest. So has a text whose bytes either encoder does
not give back, such as one with the mark U+2581. Each row of documents is one result, repeated rows and null ids
too. An empty table gives no row. Other columns of documents are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, streamed_sha256, written
from .textarrays import spans

#: Longer texts are cut into ranges of about this many characters.
CHUNK_CHARS = 1 << 16
#: A range ends inside a word only if the word has at most this many characters on either side.
STRADDLE = 1024
#: Fragments of one text that a group joins in a round.
FAN = 16
#: A block of documents closes at this many characters; its different words and pairs are kept once.
BLOCK_CHARS = 1 << 21
#: A task forgets the words it has encoded when it holds more than this many.
HELD_WORDS = 120_000
#: The counts of at most this many pairs, the most frequent, travel to every task; those of all others are joined.
FREQUENT = 1 << 17
MARK = "▁"
WORDS = re.compile(r"(?<=\S) (?=\S)")
SEPARATE = np.frombuffer(b",|;", np.uint8)


@lru_cache(2)
def _encoders(a_json: str, b_model: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(a_json)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=b_model)


@dataclass
class Spelling:
    """The bytes and the decimal digits of each id."""

    flat: np.ndarray
    at: np.ndarray
    digits: np.ndarray = field(init=False)
    width: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.at) - 1
        self.size = np.diff(self.at)
        names = [str(i) for i in range(n)]
        self.width = np.array([len(x) for x in names], np.int64)
        self.digits = np.zeros((n, len(str(n)) + 1), np.uint8)
        for i, x in enumerate(names):
            self.digits[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)

    @classmethod
    def of(cls, spelled: list[bytes]) -> Spelling:
        return cls(np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64))

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.at[ids], self.size[ids])]


@dataclass
class Pair:
    """Two tokenizers as they travel to the tasks: their files' content and their spellings; sizes are set by the vocabularies."""

    a_json: str
    b_model: bytes
    a: Spelling
    b: Spelling

    @classmethod
    def load(cls, a_file: str, b_file: str) -> Pair:
        with open(a_file, encoding="utf-8") as f:
            a_json = f.read()
        with open(b_file, "rb") as f:
            b_model = f.read()
        ta, tb = _encoders(a_json, b_model)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in plain)}
        a = [bytes(byte_of[c] for c in ta.id_to_token(i)) if set(ta.id_to_token(i) or " ") <= byte_of.keys() else b"" for i in range(ta.get_vocab_size())]
        pieces = [tb.id_to_piece(i) for i in range(tb.get_piece_size())]
        if any(MARK in x.lstrip(MARK) or " " in x for x in pieces):
            raise ValueError("a piece of the model crosses a word's start; texts cannot be encoded word by word")
        b = [bytes([int(x[3:-1], 16)]) if tb.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]
        return cls(a_json, b_model, Spelling.of(a), Spelling.of(b))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A of all words (a space before each), their number by word, the same of B, and whether both give the word's bytes."""
        ta, tb = _encoders(self.a_json, self.b_model)
        streams = [" " + w for w in words]
        of_a = [x.ids for x in ta.encode_batch_fast(streams, add_special_tokens=False)]
        of_b = tb.encode(words, num_threads=1)
        count_a, count_b = (np.array([len(x) for x in of], np.int64) for of in (of_a, of_b))
        a, b = (np.fromiter((i for x in of for i in x), np.int64, int(n.sum())) for of, n in ((of_a, count_a), (of_b, count_b)))
        raw = [s.encode("utf-8", "surrogatepass") for s in streams]
        size = np.array([len(x) for x in raw], np.int64)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        ok = np.ones(len(words), bool)
        for spelling, ids, count in ((self.a, a, count_a), (self.b, b, count_b)):
            got = np.add.reduceat(np.append(spelling.size[ids], 0), np.minimum(np.cumsum(count) - count, len(ids))) * (count > 0) if len(words) else size
            spelled = spelling.bytes(ids)
            if not np.array_equal(got, size) or not np.array_equal(spelled, whole):
                at = np.concatenate([[0], np.cumsum(got)])
                ok &= np.array([spelled[at[k] : at[k + 1]].tobytes() == raw[k] for k in range(len(words))], bool)
        return a, count_a, b, count_b, ok

    def align(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        return Aligned(self, a, b)


class Aligned:
    """Groups and links of tokens of A and B that spell the same bytes."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray) -> None:
        self.pair, self.a, self.b = pair, a, b
        self.end_a, self.end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
        near = np.minimum(np.searchsorted(self.end_b, self.end_a), max(len(b) - 1, 0))
        self.close_a = self.end_b[near] == self.end_a if len(b) else np.zeros(len(a), bool)
        self.close_b = np.zeros(len(b), bool)
        self.close_b[near[self.close_a]] = True
        self.n_groups = int(self.close_a.sum())

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A, of each token of B."""
        return np.cumsum(self.close_a) - self.close_a, np.cumsum(self.close_b) - self.close_b

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A << 32 | B of each link in order of A's tokens, and the number of links of each token of A."""
        lo = np.searchsorted(self.end_b, self.end_a - self.pair.a.size[self.a], side="right")
        hi = np.searchsorted(self.end_b - self.pair.b.size[self.b], self.end_a, side="left")
        count = hi - lo
        return np.repeat(self.a, count) << 32 | self.b[spans(lo, count)], count

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;` of each group as bytes, and the offset behind each group."""
        of_a, of_b = self.groups()
        place_a = np.arange(len(self.a)) + np.searchsorted(of_b, of_a, side="left")
        place_b = np.arange(len(self.b)) + np.searchsorted(of_a, of_b, side="right")
        n, columns = len(self.a) + len(self.b), max(self.pair.a.digits.shape[1], self.pair.b.digits.shape[1])
        cells, width = np.zeros((n, columns), np.uint8), np.zeros(n, np.int64)
        for place, ids, spelling, last, mark in ((place_a, self.a, self.pair.a, self.close_a, 1), (place_b, self.b, self.pair.b, self.close_b, 2)):
            cells[place, : spelling.digits.shape[1]] = spelling.digits[ids]
            width[place] = spelling.width[ids]
            cells[place, spelling.width[ids]] = SEPARATE[last * mark]
        out = cells[np.arange(columns) <= width[:, None]]
        return out, np.cumsum(width + 1)[place_b[self.close_b]]


class Block:
    """Documents of a task until their block is full. Words are encoded once for as long as the task holds them."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.number = pair, 0
        self._forget()
        self._start()

    def _forget(self) -> None:
        self.held: dict[str, int] = {}
        self.text: list[bytes] = []
        self.ok, self.n_a, self.n_b, self.n_groups = np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))
        self.code, self.code_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _start(self) -> None:
        self.chars, self.ids, self.docs = 0, [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        held = self.held
        words = np.array([held.setdefault(w, len(held)) for w in WORDS.split(text)], np.int64) if text else np.zeros(0, np.int64)
        self.ids.append(doc_id)
        self.docs.append(words)
        self.chars += len(text or "") + 16

    def _encode(self) -> None:
        new = list(self.held)[len(self.text) :]
        for first in range(0, len(new), 1 << 13):
            words = new[first : first + (1 << 13)]
            a, count_a, b, count_b, ok = self.pair.encode(words)
            x = self.pair.align(a[np.repeat(ok, count_a)], b[np.repeat(ok, count_b)])
            count_a, count_b = count_a * ok, count_b * ok
            raw, behind = x.text()
            code, by_token = x.links()
            groups = np.diff(np.concatenate([[0], np.cumsum(x.close_a)])[np.concatenate([[0], np.cumsum(count_a)])])
            ends = np.concatenate([[0], behind])[np.concatenate([[0], np.cumsum(groups)])]
            raw = raw.tobytes()
            self.text += [raw[ends[k] : max(ends[k], ends[k + 1] - 1)] for k in range(len(words))]
            links = np.diff(np.concatenate([[0], np.cumsum(by_token)])[np.concatenate([[0], np.cumsum(count_a)])])
            self.ok, self.n_a, self.n_b, self.n_groups = (np.concatenate(z) for z in ((self.ok, ok), (self.n_a, count_a), (self.n_b, count_b), (self.n_groups, groups)))
            self.code, self.code_at = np.concatenate([self.code, code]), np.concatenate([self.code_at, self.code_at[-1] + np.cumsum(links)])

    def row(self) -> pa.RecordBatch:
        """One row for the block's documents, its different words and its different pairs."""
        self._encode()
        size = np.array([len(w) for w in self.docs], np.int64)
        words = np.concatenate([*self.docs, np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(self.docs)), size)
        ok = np.bincount(doc, weights=~self.ok[words], minlength=len(self.docs)) == 0
        words, doc, size = words[ok[doc]], doc[ok[doc]], size * ok
        sums = [np.bincount(doc, weights=x[words], minlength=len(self.docs)).astype(np.int64) for x in (self.n_a, self.n_b, self.n_groups)]
        word_at = np.concatenate([[0], np.cumsum(size)])
        sha = [hashlib.sha256(b";".join([self.text[w] for w in words[word_at[k] : word_at[k + 1]].tolist()])).hexdigest() if size[k] else "" for k in range(len(size))]
        used, local = np.unique(words, return_inverse=True)
        links = np.diff(self.code_at)[used]
        pairs, pair = np.unique(self.code[spans(self.code_at[used], links)], return_inverse=True)
        times = np.bincount(pair, weights=np.repeat(np.bincount(local, minlength=len(used)), links), minlength=len(pairs)).astype(np.int64)
        n_links = np.bincount(doc, weights=np.diff(self.code_at)[words], minlength=len(size)).astype(np.int64)
        block = TaskContext.get().partitionId() << 32 | self.number if TaskContext.get() else self.number
        columns = [self.ids, *sums, n_links, sha, word_at.astype(np.int32), local.astype(np.int32), np.concatenate([[0], np.cumsum(links)]).astype(np.int32), pair.astype(np.int32)]
        body = pa.RecordBatch.from_arrays([pa.array([c], pa.list_(t)) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()] + [pa.int32()] * 4, strict=True)], names=BODY)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write(body)
        values = [pa.array([block], pa.int64()), pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64())), pa.array([out.getvalue().to_pybytes()], pa.binary())]
        self.number += 1
        self._start()
        if len(self.held) > HELD_WORDS:
            self._forget()
        return pa.RecordBatch.from_arrays(values, names=BLOCK_NAMES)


BLOCK_NAMES = ["block", "pairs", "times", "body"]
BLOCK = "block long, pairs array<long>, times array<long>, body binary"
#: Columns of a block's body, an Arrow stream: Spark has no use for them one by one, and so they stay packed on disk and on the way.
BODY = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "word_at", "word", "pair_at", "pair"]
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def blocks(docs: DataFrame, shared) -> DataFrame:
    """Rows of documents of bounded length, a block to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                block.add(doc_id.as_py(), text.as_py())
                if block.chars > BLOCK_CHARS:
                    yield block.row()
        if block.docs:
            yield block.row()

    return docs.mapInArrow(run, BLOCK)


def ranges(text: str, chunk: int = CHUNK_CHARS, straddle: int = STRADDLE) -> list[tuple[int, str, int, int]]:
    """(number, part of the stream that is encoded, bytes to skip, bytes that the range reaches to) of each range of a text."""
    stream = " " + text
    cuts = [(0, 0, 0)]  # where the right part starts, the range's end, where the left part ends
    while cuts[-1][2] + chunk < len(stream):
        at = cuts[-1][2] + chunk
        after = WORDS.search(stream, at)
        end = after.start() if after else len(stream)
        before = None
        for before in WORDS.finditer(stream, at - straddle, at):
            pass
        if before and end - at <= straddle and end < len(stream):
            cuts.append((before.start(), at, end))
        elif end < len(stream):
            cuts.append((end, end, end))
        else:
            break
    cuts.append((len(stream), len(stream), len(stream)))
    size = lambda x: len(x.encode("utf-8", "surrogatepass"))
    return [(k, stream[s:e], size(stream[s:p]), size(stream[s:q])) for k, ((s, p, _), (_, q, e)) in enumerate(zip(cuts, cuts[1:], strict=False))]


@dataclass
class Fragment:
    """Tokens that end in a byte range. first: the number of the range with the first common end, None if there is none; then all is in the prefix."""

    prefix: tuple[list[int], list[int]]
    first: int | None
    suffix: tuple[list[int], list[int]]


def joined(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
    """The fragment of both ranges and the group that closes between them, with the number of the range in whose front it stands."""
    plus = lambda x, y: (x[0] + y[0], x[1] + y[1])
    if right.first is None:
        if left.first is None:
            return Fragment(plus(left.prefix, right.prefix), None, ([], [])), None
        return Fragment(left.prefix, left.first, plus(left.suffix, right.prefix)), None
    if left.first is None:
        return Fragment(plus(left.prefix, right.prefix), right.first, right.suffix), None
    a, b = plus(left.suffix, right.prefix)
    return Fragment(left.prefix, left.first, right.suffix), (right.first, a, b)


def split(pair: Pair, a: np.ndarray, b: np.ndarray, skip: int, take: int, number: int) -> tuple[Fragment, np.ndarray, np.ndarray]:
    """The fragment of the tokens that end behind `skip` and up to `take` bytes, and the tokens of its closed groups."""
    end_a, end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
    in_a, in_b = (end_a > skip) & (end_a <= take), (end_b > skip) & (end_b <= take)
    a, b, end_a, end_b = a[in_a], b[in_b], end_a[in_a], end_b[in_b]
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    if not len(common):
        return Fragment((a.tolist(), b.tolist()), None, ([], [])), a[:0], b[:0]
    cut = lambda x, end: (x[end <= common[0]].tolist(), x[(end > common[0]) & (end <= common[-1])], x[end > common[-1]].tolist())
    (pa_, ca, sa), (pb, cb, sb) = cut(a, end_a), cut(b, end_b)
    return Fragment((pa_, pb), number, (sa, sb)), ca, cb


OPEN = "key long, place int, number int, first int, pa array<int>, pb array<int>, sa array<int>, sb array<int>"
CLOSED = "closed array<struct<number:int,a:array<int>,b:array<int>>>"


def fragments(parts: DataFrame, shared) -> DataFrame:
    """The fragment of each range (key, number, part, skip, take), with the text, counts and pairs of its closed groups."""

    def make():
        pair = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                key, number, part, skip, take = (batch.column(c)[row].as_py() for c in ("key", "number", "part", "skip", "take"))
                a, _, b, _, ok = pair.encode(WORDS.split(part[1:]))
                if not ok.all():
                    a = b = np.zeros(0, np.int64)
                f, ca, cb = split(pair, a, b, skip, take, number)
                x = pair.align(ca, cb)
                pairs, times = np.unique(x.links()[0], return_counts=True)
                out = {"key": key, "number": number, "ok": bool(ok.all()), "first": f.first, "pa": f.prefix[0], "pb": f.prefix[1], "sa": f.suffix[0], "sb": f.suffix[1], "n_a": len(ca), "n_b": len(cb), "n_groups": x.n_groups, "n_links": int(times.sum()), "groups": x.text()[0].tobytes()[:-1].decode(), "pairs": pairs.tolist(), "times": times.tolist()}
                yield pa.RecordBatch.from_pylist([out], schema=FRAGMENT_ARROW)

        return step

    return by_batch(parts, FRAGMENT, make)


FRAGMENT = "key long, number int, ok boolean, first int, pa array<int>, pb array<int>, sa array<int>, sb array<int>, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
FRAGMENT_ARROW = pa.schema([("key", pa.int64()), ("number", pa.int32()), ("ok", pa.bool_()), ("first", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("pa", "pb", "sa", "sb")), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _join_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Up to FAN neighbouring fragments of one text as one, and the groups that close between them."""
    rows = rows.sort_values("number")
    one, closed = None, []
    for r in rows.itertuples():
        f = Fragment((list(r.pa), list(r.pb)), None if pd.isna(r.first) else int(r.first), (list(r.sa), list(r.sb)))
        if one is None:
            one = f
        else:
            one, group = joined(one, f)
            if group:
                closed.append({"number": group[0], "a": group[1], "b": group[2]})
    return pd.DataFrame([{"key": rows.key.iloc[0], "place": int(rows.place.iloc[0]), "number": int(rows.place.iloc[0]), "first": one.first, "pa": one.prefix[0], "pb": one.prefix[1], "sa": one.suffix[0], "sb": one.suffix[1], "closed": closed}]).astype({"first": "Int32"})


def reduced(space: Scratch, found: DataFrame) -> DataFrame:
    """(key, number, a, b): the groups that no range closed by itself. Each round joins FAN fragments of a text to one."""
    level = found.select("key", "number", "first", "pa", "pb", "sa", "sb")
    closed = []
    while True:
        step = space.written(level.select("key", F.floor(F.col("number") / FAN).cast("int").alias("place"), "number", "first", "pa", "pb", "sa", "sb").groupBy("key", "place").applyInPandas(_join_group, f"{OPEN}, {CLOSED}"))
        closed.append(step.select("key", F.explode("closed").alias("g")).select("key", "g.number", "g.a", "g.b"))
        level = step.drop("closed", "place")
        if level.where("number > 0").isEmpty():
            break
    # A text starts and ends with a common end: its prefix is a group, and no suffix is left.
    closed.append(level.select("key", F.coalesce("first", F.lit(0)).alias("number"), F.col("pa").alias("a"), F.col("pb").alias("b")).where(F.size("a") > 0))
    out = closed[0]
    for x in closed[1:]:
        out = out.unionByName(x)
    return out


def measured(groups: DataFrame, shared) -> DataFrame:
    """(key, number, counts, groups, pairs, times) of groups (key, number, a, b)."""

    def make():
        pair = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                key, number, a, b = (batch.column(c)[row].as_py() for c in ("key", "number", "a", "b"))
                x = pair.align(np.array(a, np.int64), np.array(b, np.int64))
                pairs, times = np.unique(x.links()[0], return_counts=True)
                out = {"key": key, "number": number, "n_a": len(a), "n_b": len(b), "n_groups": x.n_groups, "n_links": int(times.sum()), "groups": x.text()[0].tobytes()[:-1].decode(), "pairs": pairs.tolist(), "times": times.tolist()}
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([f for f in FRAGMENT_ARROW if f.name in out]))

        return step

    return by_batch(groups, "key long, number int, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>", make)


def _cut(docs: DataFrame, chunk: int) -> DataFrame:
    """(key, doc_id, number, part, skip, take): the ranges of long texts; key: one for each row of docs."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                key, doc_id = batch.column("key")[row].as_py(), batch.column("doc_id")[row].as_py()
                for number, part, skip, take in ranges(batch.column("text")[row].as_py(), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([number], pa.int32()), pa.array([part], pa.string()), pa.array([skip], pa.int64()), pa.array([take], pa.int64())], names=["key", "doc_id", "number", "part", "skip", "take"])

        return step

    return by_batch(docs.withColumn("key", F.monotonically_increasing_id()), "key long, doc_id long, number int, part string, skip long, take long", make)


def _scored(rows: DataFrame, codes: np.ndarray, n: np.ndarray, top: np.ndarray) -> DataFrame:
    """A row for each document of the blocks, with the sums over its frequent pairs and the others as `rare`. codes: the frequent pairs, sorted."""
    shared = rows.sparkSession.sparkContext.broadcast((codes, n, top))

    def make():
        frequent, n_of, top_of = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                body = pa.ipc.open_stream(batch.column("body")[row].as_buffer()).read_next_batch()
                get = lambda c: body.column(c)[0].values  # noqa: B023, E731
                pairs = batch.column("pairs")[row].values.to_numpy()
                word_at, pair_at, word, pair = (get(c).to_numpy() for c in ("word_at", "pair_at", "word", "pair"))
                at = np.minimum(np.searchsorted(frequent, pairs), max(len(frequent) - 1, 0))
                known = frequent[at] == pairs if len(frequent) else np.zeros(len(pairs), bool)
                by_word = lambda value: np.diff(np.concatenate([[0], np.cumsum(value[pair])])[pair_at])  # noqa: B023, E731
                sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(by_word(np.where(known, of[at], 0) if len(frequent) else np.zeros(len(pairs), np.int64))[word])])[word_at])) for of in (top_of, n_of)]
                docs = len(word_at) - 1
                rare_word = by_word(~known) > 0
                here = np.flatnonzero(rare_word[word])
                doc, links = np.searchsorted(word_at, here, side="right") - 1, np.diff(pair_at)[word[here]]
                one = np.repeat(doc, links) * len(pairs) + pair[spans(pair_at[word[here]].astype(np.int64), links)]
                one, times = np.unique(one[~known[one % max(len(pairs), 1)]], return_counts=True)
                rare = pa.ListArray.from_arrays(np.searchsorted(one // max(len(pairs), 1), np.arange(docs + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(pairs[one % max(len(pairs), 1)]), pa.array(times.astype(np.int64))], names=["pair", "times"]))
                block = pa.array(np.full(docs, batch.column("block")[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(docs)), get("doc_id"), get("n_a"), get("n_b"), get("n_groups"), get("n_links"), *sums, get("groups_sha256"), rare], names=["block", "place", "doc_id", *COUNTS, "groups_sha256", "rare"])

        return step

    return by_batch(rows, f"block long, place long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, rare array<struct<pair:bigint,times:bigint>>", make)


def aligned(docs: DataFrame, a_file: str, b_file: str, chunk: int = CHUNK_CHARS, pairs: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. With pairs also the corpus-wide table a, b, n, top (1 if no other A id is linked more often with b)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pair.load(a_file, b_file))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark) as space:
        size = F.coalesce(F.length("text"), F.lit(0))
        short = space.written(blocks(docs.where(size <= chunk), shared))
        parts = space.written(_cut(docs.where(size > chunk), chunk))
        found = space.written(fragments(parts.repartition("key", "number"), shared))
        bad = found.where("not ok").select("key").distinct()
        good = found.join(bad, "key", "left_anti").drop("ok")
        rest = space.written(measured(reduced(space, good), shared))
        long = good.select(rest.columns).withColumn("half", F.lit(1)).unionByName(rest.withColumn("half", F.lit(0)))
        links = long.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("key", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
        every = short.select(F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(F.col("z.pairs").alias("pair"), F.col("z.times").alias("times")).unionByName(links.select("pair", "times"))
        counts = space.written(every.groupBy("pair").agg(F.sum("times").alias("n")))
        b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
        best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # at most a row for each id of B
        counts = space.written(counts.join(F.broadcast(best), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("top")))
        often = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT).collect()  # a bounded list; the other pairs are joined
        often = np.array(sorted((r.pair, r.n, r.top) for r in often), np.int64).reshape(-1, 3).T
        one = space.written(_scored(short, *often))
        added = one.select("block", "place", F.explode("rare").alias("r")).select("block", "place", F.col("r.pair").alias("pair"), F.col("r.times").alias("times")).join(counts, "pair")
        added = added.groupBy("block", "place").agg(F.sum(F.col("times") * F.col("top")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        one = one.join(added, ["block", "place"], "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
        one = one.select("doc_id", *COUNTS, "groups_sha256")
        sums = links.join(counts, "pair").groupBy("key").agg(F.sum(F.col("times") * F.col("top")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        digests = streamed_sha256(long.where("n_groups > 0").select("key", "number", "half", "groups"), ["key"], ["number", "half"], "groups", ";")
        totals = long.groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS[:4]))
        whole = parts.where("number = 0").select("key", "doc_id").join(totals, "key", "left").join(sums, "key", "left").join(digests, "key", "left")
        many = whole.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("sha256", F.lit("")).alias("groups_sha256"))
        out = written(one.unionByName(many))
        if pairs:
            return out, written(counts.select(F.shiftright("pair", 32).alias("a"), b_id.alias("b"), "n", "top"))
    return out


def spans_of(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The groups themselves: doc_id, place, start and end (bytes of the space and the text), a_ids, b_ids. Texts without tokens give no row."""
    shared = docs.sparkSession.sparkContext.broadcast(Pair.load(a_file, b_file))

    def make():
        pair = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                if not text:
                    continue
                a, _, b, _, ok = pair.encode(WORDS.split(text))
                if not ok.all():
                    continue
                x = pair.align(a, b)
                ends = x.end_a[x.close_a]
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.flatnonzero(c) + 1]).astype(np.int32), pa.array(ids.astype(np.int32))) for c, ids in ((x.close_a, x.a), (x.close_b, x.b))]
                doc_id = pa.array([batch.column("doc_id")[row].as_py()] * len(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.arange(len(ends))), pa.array(np.concatenate([[0], ends[:-1]])), pa.array(ends), *lists], names=["doc_id", "place", "start", "end", "a_ids", "b_ids"])

        return step

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, place long, start long, end long, a_ids array<int>, b_ids array<int>", make)

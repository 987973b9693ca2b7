from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.llm import sentencepieces as sp
from taxaloom.llm.queries import tokenizer
from taxaloom.llm.textarrays import mix

ODD = ["", " ", "a", "\n\n", "  the  cat\tsat\r\n", "▁ literal mark ▁▁", "naïve café 𝄞🎉", "x" * 9000, "\x00\x07 control", "the theory of everything"]


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.load(tokenizer())


def naive(p, words, text, key, seed):
    """Forward filtering and backward sampling, one character at a time, from a dict of pieces."""
    bounds = sp.segment_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]))
    row = mix(np.array([key], np.uint64) ^ mix(np.array([seed], np.uint64)))[0]
    ids = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        alpha = {a: 0.0}
        into = {}
        for e in range(a + 1, b + 1):
            edges = []
            for s in range(e - 1, max(a, e - 60) - 1, -1):
                if text[s:e] in words:
                    edges.append((s, words[text[s:e]], p.logp[words[text[s:e]]]))
                elif s == e - 1:
                    edges.append((s, -1, p.logp[p.byte_ids[0]] * len(text[s].encode())))
            edges.sort(key=lambda x: x[0])
            value = [w + alpha[s] for s, _, w in edges]
            top = max(value)
            alpha[e] = top + math.log(sum(math.exp(v - top) for v in value))
            into[e] = [(s, i, math.exp(v - alpha[e])) for (s, i, _), v in zip(edges, value, strict=True)]
        e, out = b, []
        while e > a:
            u = float(mix(np.array([row + np.uint64(e) * np.uint64(0x9E3779B97F4A7C15)], np.uint64))[0] >> np.uint64(11)) * 2.0**-53
            total = 0.0
            for s, i, share in into[e]:
                total += share
                if u < total:
                    break
            out.append([i] if i >= 0 else [int(p.byte_ids[x]) for x in text[s].encode()])
            e = s
        ids += [i for x in reversed(out) for i in x]
    return ids


def test_matches_a_plain_sampler(pieces):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    words = {}
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)):
            text = m.id_to_piece(i)
            if "▁" not in text.lstrip("▁") and "\n" not in text:
                words.setdefault(text.replace("▁", " "), i)
    texts = [t for t in ODD if len(t) < 100]
    with np.errstate(over="ignore"):
        ids, at = sp.Sampler(pieces, 7)(texts, np.arange(len(texts), dtype=np.uint64))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == naive(pieces, words, t, k, 7), t


def test_lossless_and_independent_of_batches(pieces):
    s = sp.Sampler(pieces, 7)
    keys = np.arange(len(ODD), dtype=np.uint64)
    ids, at = s(ODD, keys)
    for k, t in enumerate(ODD):
        own = ids[at[k] : at[k + 1]]
        assert sp.decode_ids(pieces, own).decode() == t
        alone, _ = s([t], keys[k : k + 1])
        assert own.tolist() == alone.tolist()
    other, _ = sp.Sampler(pieces, 8)(ODD, keys)
    assert other.tolist() != ids.tolist()


def test_dataframe(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)] + [(None, None, None), (3, "a b", "z")], "doc_id long, text string, decoded2 string")
    out = sp.decode(sp.encode(df, tokenizer(), F.col("doc_id")), tokenizer()).collect()
    assert len(out) == len(ODD) + 2
    assert all(r.decoded == (r.text or "") for r in out)
    with pytest.raises(ValueError):
        sp.encode(df.withColumn("piece_ids", F.lit(1)), tokenizer(), F.col("doc_id"))
    assert sp.encode(df.limit(0), tokenizer(), F.col("doc_id")).count() == 0


def test_long_segments_are_not_cut(pieces):
    """An unspaced text has the sampled distribution of the whole lattice: its likelihood does not fall at any border."""
    text = "thequickbrownfox" * 1250
    assert sp.segment_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)])).tolist() == [0, len(text)]
    s = sp.Sampler(pieces, 7)
    ids, at = s([text, text], np.arange(2, dtype=np.uint64))
    for k in range(2):
        own = ids[at[k] : at[k + 1]]
        assert sp.decode_ids(pieces, own).decode() == text
        ends = np.cumsum(pieces.spelled_at[own + 1] - pieces.spelled_at[own])
        assert not np.isin(np.arange(4096, len(text), 4096), ends).all()
    assert ids[at[0] : at[1]].tolist() != ids[at[1] : at[2]].tolist()


def test_longer_pieces_with_larger_theta(spark):
    df = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog") for i in range(50)], "doc_id long, text string")
    n = [sp.encode(df, tokenizer(), F.col("doc_id"), theta=t).agg(F.sum(F.size("piece_ids"))).first()[0] for t in (0.2, 1.0, 3.0)]
    assert n[0] > n[1] > n[2]

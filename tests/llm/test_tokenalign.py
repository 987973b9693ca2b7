from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaloom.llm import tokenalign
from taxaloom.llm.queries import op13_token_alignment, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["plain words, here", " lead", "trail  ", "a\n b\t c  d", "mark ▁ inside", "▁", "<|endoftext|> and <s> </s> <unk>", "žluťoučký kůň 漢字かな 😀😀 \x00\x1c x", "don't I'll  we're", "x" * 3000, "é" * 2000, "漢" * 1500, "a b " * 3000, "   x y　z w", " ", "\n", "no-break  space and \x85 next line", "🏳️‍🌈 é"]


@pytest.fixture(scope="module")
def pair():
    return tokenalign.Pair.load(tokenizer(A), tokenizer(B))


def whole(pair, text):
    """Tokens of the whole text, encoded in one piece; empty if the bytes are not those of the stream."""
    ta, tb = tokenalign._encoders(pair.a_json, pair.b_model)
    a, b = ta.encode(" " + (text or ""), add_special_tokens=False).ids, tb.encode(text or "")
    spell = lambda s, ids: [s.flat[s.at[i] : s.at[i + 1]].tobytes() for i in ids]
    sa, sb = spell(pair.a, a), spell(pair.b, b)
    stream = (" " + (text or "")).encode()
    return (a, b, sa, sb) if text and b"".join(sa) == stream == b"".join(sb) else ([], [], [], [])


def brute(pair, texts):
    """All by nested loops over bytes."""
    found, pairs = [], Counter()
    for t in texts:
        a, b, sa, sb = whole(pair, t)
        span = lambda s: [(sum(map(len, s[:k])), sum(map(len, s[: k + 1]))) for k in range(len(s))] if len(s) < 400 else list(zip(np.cumsum([0, *map(len, s)])[:-1].tolist(), np.cumsum([*map(len, s)]).tolist(), strict=True))
        xa, xb = span(sa), span(sb)
        common = sorted({e for _, e in xa} & {e for _, e in xb})
        groups, links, start = [], [], 0
        ia = ib = 0
        for end in common:
            ga, gb = ia, ib
            while ia < len(xa) and xa[ia][1] <= end:
                ia += 1
            while ib < len(xb) and xb[ib][1] <= end:
                ib += 1
            groups.append(",".join(map(str, a[ga:ia])) + "|" + ",".join(map(str, b[gb:ib])))
            links += [(a[i], b[j]) for i in range(ga, ia) for j in range(gb, ib) if xa[i][0] < xb[j][1] and xb[j][0] < xa[i][1]]
            start = end
        assert start == sum(map(len, sa))
        pairs.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, j), n in pairs.items():
        most[j] = max(most[j], n)
    return [(na, nb, ng, len(ls), sum(pairs[x] == most[x[1]] for x in ls), sum(pairs[x] for x in ls), h) for na, nb, ng, ls, h in found], pairs


def result(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


@pytest.mark.parametrize(("chunk", "frequent"), [(1 << 16, 1 << 17), (700, 20), (1 << 16, 0)])
def test_brute_force(spark, pair, monkeypatch, chunk, frequent):
    monkeypatch.setattr(tokenalign, "FREQUENT", frequent)
    texts = [None, "", *ODD, *ODD[:3]]
    docs = spark.createDataFrame([(None if k == 5 else k, "x", t) for k, t in enumerate(texts)], "doc_id long, n_a string, text string").repartition(3)
    got, pairs = tokenalign.aligned(docs, tokenizer(A), tokenizer(B), chunk, pairs=True)
    want, counts = brute(pair, texts)
    rows = {r.doc_id: result(r) for r in got.collect()}
    assert rows == {None if k == 5 else k: w for k, w in enumerate(want)}
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)
    assert tokenalign.aligned(docs.limit(0), tokenizer(A), tokenizer(B)).count() == 0


def test_query(spark, sf, pair):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r.doc_id: result(r) for r in op13_token_alignment(spark, sf).collect()}
    want, _ = brute(pair, [d.text for d in docs])
    assert rows == {d.doc_id: w for d, w in zip(docs, want, strict=True)}


def test_one_long_text(spark, pair):
    """A text of 400,000 characters in ranges of 500: several rounds of joining."""
    r = np.random.default_rng(3)
    text = " ".join(r.choice(["word", "naïve", "漢字", "x" * 40, "a\n", "1234567", "", "don't"], 70000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [result(x) for x in tokenalign.aligned(docs, tokenizer(A), tokenizer(B), 500).collect()] == brute(pair, [text])[0]


def test_spans(spark, pair):
    docs = spark.createDataFrame(list(enumerate([None, "", *ODD])), "doc_id long, text string")
    rows = tokenalign.spans_of(docs, tokenizer(A), tokenizer(B)).orderBy("doc_id", "place").collect()
    for k, t in enumerate([None, "", *ODD]):
        mine = [x for x in rows if x.doc_id == k]
        a, b, _, _ = whole(pair, t)
        assert [i for x in mine for i in x.a_ids] == a and [i for x in mine for i in x.b_ids] == b
        assert all(x.end == y.start for x, y in zip(mine, mine[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_monoid(pair, data):
    """Any byte cuts and any bracketing give the groups of the whole text."""
    text = data.draw(st.text(st.sampled_from("ab é漢'x1 \n"), min_size=1, max_size=60))
    a, b, *_ = whole(pair, text)
    if not a:
        return
    n = len((" " + text).encode())
    cuts = sorted({0, n, *data.draw(st.lists(st.integers(0, n), max_size=6))})
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    groups, parts = {}, []
    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        f, ca, cb = tokenalign.split(pair, x, y, s, e, k)
        groups[k, 1] = pair.align(ca, cb).text()[0].tobytes()[:-1].decode()
        parts.append(f)
    text_of = lambda g: f"{','.join(map(str, g[1]))}|{','.join(map(str, g[2]))}"
    while len(parts) > 1:
        k = data.draw(st.integers(0, len(parts) - 2))
        f, closed = tokenalign.joined(parts[k], parts[k + 1])
        if closed:
            groups[closed[0], 0] = text_of(closed)
        parts[k : k + 2] = [f]
    assert parts[0].suffix == ([], [])
    groups[parts[0].first, 0] = text_of((0, *parts[0].prefix))
    assert hashlib.sha256(";".join(groups[g] for g in sorted(groups) if groups[g]).encode()).hexdigest() == brute(pair, [text])[0][0][-1]


def test_ranges_cover_the_stream():
    text = " ".join(["w" * k for k in range(1, 90)]) + "y" * 3000 + " " + "z" * 10
    size = 0
    for _, part, skip, take in tokenalign.ranges(text, 300, 50):
        assert part.startswith(" ") and 0 <= skip <= take <= len(part)
        size += take - skip
    assert size == len(text) + 1

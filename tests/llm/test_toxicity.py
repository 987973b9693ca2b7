from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from taxaloom.llm import toxicity
from taxaloom.llm.queries import op11_toxicity

MEDIUM = "/root/testdata/sf0.01"
BAD = ["awful", "nasty", "vile", "Gemein", "méchant"]
PLAIN = "the sun is over hill and river while people walk along roads with bread for their friends".split()


def made(seed, n):
    r = np.random.default_rng(seed)
    docs, labels = [], []
    for k in range(n):
        words = list(r.choice(PLAIN, size=int(r.integers(3, 60))))
        toxic = int(k % 4 == 0)
        for w in r.choice(BAD, size=int(r.integers(1, 6)) if toxic else int(r.random() < 0.05)):
            words.insert(int(r.integers(0, len(words))), w + r.choice(["", ",", "!"]))
        docs.append((k, " ".join(words), "x", 1))
        if k % 5:
            labels.append((k, 1, toxic))
    return docs, labels


def words(text):
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text or "")]


def plain_model(docs, labels):
    """Vocabulary, frequencies, examples and calibration by plain Python."""
    text = {d[0]: d[1] for d in docs}
    learn = sorted({(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in text})
    n1 = sum(y for _, y in learn)
    n0 = len(learn) - n1
    a, m = Counter(), Counter()
    for i, y in learn:
        for w in set(words(text[i])):
            m[w] += 1
            a[w] += y
    n = n0 + n1
    part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
    g = {w: 2 * (part(a[w], m[w] * n1 / n) + part(m[w] - a[w], m[w] * n0 / n) + part(n1 - a[w], (n - m[w]) * n1 / n) + part(n0 - m[w] + a[w], (n - m[w]) * n0 / n)) for w in m}
    vocabulary = {w for w in g if g[w] >= toxicity.EVIDENCE}
    df = Counter(w for d in docs for w in set(words(d[1])) & vocabulary)
    idf = {w: math.log((len(docs) + 1) / (df[w] + 1)) + 1 for w in vocabulary}

    def vector(t):
        c = Counter(w for w in words(t) if w in vocabulary)
        v = {w: (1 + math.log(k)) * idf[w] for w, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = [(i, y, vector(text[i])) for i, y in learn if vector(text[i])]

    def nearest(v, but=None):
        found = [(-round(sum(x * e.get(w, 0) for w, x in v.items()), 9), i, y) for i, y, e in examples if i != but]
        return sorted(x for x in found if x[0] < 0)[: toxicity.K]

    def share(near):
        votes = [(1 / (1 + c + toxicity.NEAR), y) for c, _, y in near]
        return sum(v * y for v, y in votes) / sum(v for v, _ in votes)

    bins = np.zeros((toxicity.BINS + 2, 2))
    for i, y in learn:
        near = nearest(vector(text[i]), i)
        bins[round(share(near) * toxicity.BINS) if near else toxicity.BINS + 1, y] += 1
    rate = (n1 + 0.5) / (n + 1)
    smooth = (bins[:, 1] + rate) / (bins.sum(1) + 1)
    table = toxicity.monotone(smooth[:-1], bins[:-1].sum(1) + 1)

    def score(t):
        near = nearest(vector(t))
        return (float(np.interp(share(near) * toxicity.BINS, np.arange(toxicity.BINS + 1), table)) if near else smooth[-1]), near

    return vocabulary, score


@pytest.mark.parametrize("block", [4, 64])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    docs, labels = made(1, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string, n int").repartition(4)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    vocabulary, score = plain_model(docs, labels)
    assert len(model.vocabulary) == len(vocabulary) and {"awful", "méchant", "gemein"} <= vocabulary
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 400 and df.columns == rows[0].__fields__[:4]
    for r in rows:
        s, near = score(r.text)
        assert abs(r.toxicity - s) < 1e-6
        assert [(e.doc_id, e.toxic) for e in r.evidence] == [(i, y) for _, i, y in near]
        assert np.allclose([e.cosine for e in r.evidence], [-c for c, _, _ in near], atol=1e-6)


def test_monotone():
    assert toxicity.monotone(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]
    assert toxicity.monotone(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 2.0])).tolist() == [1.75] * 3


def test_held_out(spark):
    out = op11_toxicity(spark, MEDIUM)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.93


def test_edges(spark):
    docs, labels = made(2, 200)
    odd = [(None, None, "x", 1), (900, "", "x", 1), (901, "12 $$ \n", "x", 1), (902, "awful " * 60_000, "x", 1), (903, "plain words only", "x", 1), (904, "AWFUL vile", "x", 1), (904, "AWFUL vile", "x", 1)]
    df = spark.createDataFrame(docs + docs[:9] + odd, "doc_id long, text string, toxic string, n int")
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (903, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 216
    by = {r.doc_id: r for r in rows}
    assert by[None].toxicity == by[900].toxicity == by[901].toxicity == by[903].toxicity == model.without < 0.3 and by[900].evidence == []
    assert by[902].toxicity > 0.5 and by[904].toxicity > 0.5
    again = toxicity.fit(df.repartition(7), marks)
    assert sorted((r.doc_id or -1, r.toxicity) for r in toxicity.score(df, again).collect()) == sorted((r.doc_id or -1, r.toxicity) for r in rows)
    none = toxicity.fit(df, marks.limit(0))
    assert {r.toxicity for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df.limit(0), marks).without == 0.5
    with pytest.raises(ValueError):
        toxicity.score(df, model, "toxic")
    assert len(toxicity.fit(df, marks, examples=10).index.ids) == 10

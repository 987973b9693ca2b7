"""Every stage against a plain version of its decision, run on the stage's own input, with odd rows among the documents."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from taxaloom.llm import mixing, quality, rules, sentencepieces
from taxaloom.llm.common import written
from taxaloom.llm.queries import tokenizer
from tests.llm.test_jaccard import brute

PLAIN = "the old house by the river was quiet and nobody came to see who had left the light on in the hall that night"
ODD = [
    (None, None, None, None, None),
    (None, "", "en", "web", 0),
    (None, PLAIN, None, None, 1),
    (900001, "  \n\t", "xx", "web", 4),
    (900002, PLAIN * 30, "en", None, 1),
    (900003, PLAIN + " x" * 300_000, "en", "web", 1),
    (900004, PLAIN, None, "odd source", None),
    (900004, PLAIN, None, "odd source", None),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(row):
    return (row.doc_id, row.text, row.lang, row.source, row.n_chars)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("rate", F.lit("a clashing name"))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "quality_rules", "jaccard_join", "mixing_sources", "sentencepiece"]
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, sf))
        by_stage[name] = (before, docs.collect())
        assert name == "sentencepiece" or docs.columns == columns

    before, after = by_stage["quality_classifier"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long, c string"), labels)
    want = [key(r) for r in before if model.score(quality.statistics([r.text or ""]))[0] >= 0.3]
    assert sorted(map(str, map(key, after))) == sorted(map(str, want)) and len(want) > 0.5 * len(before)

    before, after = by_stage["quality_rules"]
    kept = {str(key(r)) for r in after}
    for r in before:
        w = words(r.text)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeats = len({p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + 8)})
        if len(w) < 20 or 100 * repeats > 30 * len(w):
            assert str(key(r)) not in kept
        elif len(w) < rules.MIN_WORDS or r.lang is None:
            assert str(key(r)) in kept
    assert len(after) > 0.5 * len(before)

    before, after = by_stage["jaccard_join"]
    classes = brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(str(r.doc_id) for r in after if words(r.text)) == sorted({str(c) for _, n, c in classes if n})

    before, after = by_stage["mixing_sources"]
    sizes = spark.createDataFrame([(r.doc_id, r.source, len(words(r.text))) for r in before], "doc_id long, source string, size long")
    rate = {r.source: r.rate for r in mixing.targets(sizes).collect()}
    count = {}
    for r in after:
        count[key(r)] = count.get(key(r), 0) + 1
    for r in before:
        x = rate[r.source]
        assert count.get(key(r), 0) in ((1,) if x is None else (int(np.floor(x)), int(np.floor(x)) + 1))
    assert set(count) <= set(map(key, before))

    before, after = by_stage["sentencepiece"]
    pieces = sentencepieces.Pieces.load(tokenizer())
    texts = sorted((str(r.doc_id), r.text or "") for r in before)
    assert sorted((str(r.doc_id), sentencepieces.decode_ids(pieces, np.array(r.piece_ids, np.int64)).decode() if r.piece_ids else "") for r in after) == texts
    copies = {}
    for r in after:
        copies.setdefault(r.doc_id, []).append(tuple(r.piece_ids))
    several = [v for k, v in copies.items() if len(v) > 1 and len(v[0]) > 50]
    assert several and all(len(set(v)) == len(v) for v in several)


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0

"""Windows of sequences in numpy against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from taxaloom import scratch
from taxaloom.operators import cluster, kmer, textindex, windows


def opposite(x):
    return "".join(c if c in "ACGT" else "N" for c in x)[::-1].translate(str.maketrans("ACGT", "TGCA"))


def texts(r, n):
    out = ["".join(r.choices("ACGT", k=r.randrange(0, 60))) for _ in range(n)] + ["", "ACG", "ACGNNACGTTAC", "acgtACGTTxACGTA", "ACGTÑACGTAC", "ACGT\U0001d49eACGTTGCA"]
    return [(i, s) for i, s in enumerate(out)] + [(0, "ACGTACGTTGCAACGT"), (n + 9, None)]


@pytest.mark.parametrize("chars", [1 << 21, 50])
def test_canonical_pairs(spark, monkeypatch, chars):
    monkeypatch.setattr(windows, "CHARS", chars)
    rows = texts(random.Random(3), 40)
    got = windows.canonical_pairs(spark.createDataFrame(rows, "id long, s string").coalesce(1), ["id"], [3, 8, 31]).collect()
    want = [(i, a) for i, s in rows for k in (3, 8, 31) for a in {min(x, opposite(x)) for x in (s[p : p + k] for p in range(len(s or "") - k + 1))}]
    assert sorted(map(tuple, got)) == sorted(want)


def test_filter_keeps_all_known(spark, monkeypatch):
    """A table of few bits lets more windows pass, and none that are known are lost."""
    monkeypatch.setattr(windows, "SLOTS", (1009,))
    rows = texts(random.Random(5), 300)
    df = spark.createDataFrame(rows, "id long, s string")
    every = {tuple(x) for x in windows.canonical_pairs(df, ["id"], [9]).collect()}
    near = sorted({a for i, a in every if i % 7 == 0})
    got = {tuple(x) for x in windows.canonical_pairs(df, ["id"], [9], spark.createDataFrame([(a,) for a in near], "kmer string")).collect()}
    assert got <= every and {x for x in every if x[1] in near} <= got


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_shared_hits(spark):
    """As pair_hits and fractional_hits, also for rows that share their id; hits are not exchanged: those of 400 owners on 50 equal targets shuffle less than a byte each."""
    r = random.Random(8)
    t = spark.createDataFrame([(i, s) for i, s in texts(r, 20) if i != 0], "item_id long, s string")
    index = kmer.kmer_index(t, 4, "item_id")
    for rows in (texts(r, 30), [x for x in texts(r, 30) if x[0]]):
        owners = spark.createDataFrame(rows, "doc_id long, s string")
        one, two = kmer.pair_hits(owners, index, 4, "doc_id"), kmer.shared_hits(owners, index, [4], ["doc_id"], ["item_id"])
        assert sorted(map(tuple, one.select("doc_id", "a", "item_id").collect())) == sorted(map(tuple, two.select("doc_id", "a", "item_id").collect()))
        score = lambda x: {(y.doc_id, y.item_id): round(y.score, 9) for y in x.collect()}
        assert score(kmer.fractional_hits(one, ["doc_id"], ["item_id"])) == score(kmer.sum_of_shares(two, "doc_id", "item_id"))
    text = "".join(r.choices("ACGT", k=500))
    owners = spark.createDataFrame([(i, text) for i in range(400)], "doc_id long, s string").repartition(4)
    many = kmer.kmer_index(spark.createDataFrame([(i, text) for i in range(50)], "item_id long, s string"), 12, "item_id")
    before = shuffled(spark)
    n = kmer.unit_hits(kmer.shared_hits(owners, many, [12], ["doc_id"], ["item_id"]), "doc_id").collect()
    assert {x.n for x in n} == {50 * len({min(x, opposite(x)) for x in (text[p : p + 12] for p in range(489))})}
    assert shuffled(spark) - before < 400 * 489 * 50


def test_opposite(spark):
    df = spark.createDataFrame([("ACGN",), ("AAx",)], "s string").select(windows.opposite(F.col("s")).alias("x"))
    assert [x.x for x in df.collect()] == ["NCGT", "xTT"]


def test_classify_reads(spark):
    """Windows as numbers: as plain Python, with other characters too."""
    r = random.Random(4)
    pool = ["".join(r.choices("ACGT", k=40)) for _ in range(4)]
    rows = [(i, "".join(r.choices(pool, k=3)) + r.choice(["", "N", "ÑAC"]) + r.choice(pool)) for i in range(30)] + [(40, ""), (41, None), (42, "ACG")]
    k, ext, more = 4, 5, 3
    n, want = {}, {}
    at = lambda s: [s[p : p + k + ext] for p in range(len(s or "") - k - ext + 1)]
    for _, s in rows:
        for w in set(at(s)):
            n[w] = n.get(w, 0) + 1
    for i, s in rows:
        if c := sum(n[w] > more for w in {w[ext:]: w for w in at(s)}.values()):
            want[i] = c
    df = spark.createDataFrame(rows, "id long, s string")
    assert {x.id: x.n for x in textindex.classify_reads(df, df, k, ext, more, "id").collect()} == want
    assert dict(windows.coded(df, ["id"], k + ext, k).dtypes)["code"] == "bigint"


@pytest.mark.parametrize("shared", [False, True])
def test_qmer_shares(spark, monkeypatch, shared):
    """Shares among all windows, those with other characters too; texts of 100,000 bases shuffle less than a tenth of a byte a base."""
    monkeypatch.setattr(windows, "CHARS", 50)
    r = random.Random(9)
    rows = [x for x in texts(r, 30) if shared or x[0]]
    want = {}
    for i, s in rows:
        for x in (s[p : p + 3] for p in range(len(s or "") - 2)):
            want.setdefault(i, []).append(min(x, opposite(x)))
    slots = sorted({min(x, opposite(x)) for x in ("".join(y) for y in itertools.product("ACGT", repeat=3))})
    got = {x.id: x.profile for x in cluster.qmer_vectors(spark.createDataFrame(rows, "id long, s string"), 3, "id").collect()}
    assert got == {i: [x.count(y) / len(x) for y in slots] for i, x in want.items()}
    monkeypatch.undo()
    if not shared:
        long = spark.createDataFrame([(i, "".join(r.choices("ACGT", k=100_000))) for i in range(16)], "id long, s string").repartition(8)
        long = scratch.written(long)
        before = shuffled(spark)
        cluster.qmer_vectors(long, 6, "id").write.format("noop").mode("overwrite").save()
        assert shuffled(spark) - before < 160_000

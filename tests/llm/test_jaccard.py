from __future__ import annotations

import random
import re

import numpy as np

from taxaloom.llm import common, jaccard
from taxaloom.llm.queries import op3_jaccard_join


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for m in by.values() for x, a in enumerate(m) for b in m[x + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            comp[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i]:
            least.setdefault(find(i), []).append(k)
    least = {c: min((k for k in ks if k is not None), default=None) for c, ks in least.items()}
    return sorted(((k, len(s), least[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def made():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append([r.choice(words) for _ in range(r.randint(1, 120))])
    shared = [r.choice(words) for _ in range(60)]
    for _ in range(40):  # a passage that many documents share
        rows.append([r.choice(words) for _ in range(r.randint(1, 80))] + shared)
    for base in rows[:20]:  # near copies, some at the limit
        for k in (1, 2, 4, 8, 12):
            c = list(base)
            for _ in range(k):
                c[r.randrange(len(c))] = r.choice(words)
            rows.append(c)
    big = [r.choice(words) for _ in range(100)]
    for _ in range(60):  # a large group of near copies of one text
        c = list(big)
        for _ in range(r.randint(0, 3)):
            c[r.randrange(len(c))] = r.choice(words)
        rows.append(c)
    texts = [" ".join(x) for x in rows] + ["", None, "  \n", "One two", "one TWO", "one  two\tthree four", "a b c d e"]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[70], out[3], (3, "another text with the same id"), (None, texts[5]), (None, "alone without an id at all"), (None, "another one without any id")]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, key string")
    for n, percent in ((5, 80),):
        assert got(jaccard.jaccard_components(df, n, percent)) == brute(rows, n, percent)


def test_frequent_columns_and_tiles_change_nothing(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "PART", 4)
    monkeypatch.setattr(jaccard, "BUCKET_GRAMS", 500)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    assert got(jaccard.jaccard_components(df)) == brute(rows, 4, 85)
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect() if r.doc_id is not None) == sorted(r.doc_id for r in jaccard.keep_one(df.coalesce(1)).collect() if r.doc_id is not None)


def test_near_copies_below_the_limit(spark, monkeypatch):
    """300 near copies that mostly do not link: no row for each pair leaves a task, and the components are exact."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        c = list(base)
        for k in r.sample(range(200), 2 + i % 2):  # 4 n-grams change with each word, so most pairs are at 0.78 to 0.85
            c[k] = f"x{i}_{k}"
        rows.append((i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = jaccard.linked

    def counted(*a):
        out = plain(*a)
        seen.append((a[0].count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "linked", counted)
    for part in (1024, 64):
        monkeypatch.setattr(jaccard, "PART", part)
        assert got(jaccard.jaccard_components(df)) == brute(rows, 4, 85)
    assert all(out <= rows_in <= 300 * 20 for rows_in, out in seen) and len(seen) >= 3  # of 44,850 pairs


def test_overlaps_of_a_tile(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 80))).astype(np.uint64) for _ in range(40)]
    label = np.arange(40) % 9
    for left in (np.ones(40, bool), np.arange(40) < 15):
        a, b = jaccard.overlapping(sets, label, left, 60)
        want = {(i, j) for i in range(40) for j in range(40) if left[i] and (i < j if left.all() else not left[j]) and label[i] != label[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want


def test_every_linked_set_shares_enough_first_columns():
    rng = np.random.default_rng(6)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for percent in (80, 85):
        for _ in range(3000):
            x = np.unique(rng.integers(0, 1 << 30, rng.integers(1, 90)).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.choice([0, 0.05, 0.15])], rng.integers(0, 1 << 30, rng.integers(0, 9)).astype(np.uint64)]))
            if len(y) and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
                both = np.intersect1d(jaccard.first_columns(x, none, percent), jaccard.first_columns(y, none, percent))
                assert len(both) >= max(jaccard.least_shared(jaccard.needed(len(z), percent), percent) for z in (x, y))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).count() == 0
    assert jaccard.keep_one(df).count() == 0


def test_keep_one(spark):
    rows = made()
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = {(c) for k, n, c in brute(rows, 4, 85) if n}
    have = [r.doc_id for r in kept.where("trim(translate(text, '\n', ' ')) <> ''").collect()]
    # Two components have no id at all, and two have 3 as their smallest.
    assert set(have) == want and len(have) == len(want) + 2


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op3_jaccard_join(spark, sf)) == brute(docs, 4, 85)

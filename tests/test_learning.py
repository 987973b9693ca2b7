"""Learned levels, extended reads, Spearman clusters, ordered merging and the bucketed index, against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from taxaloom.functions import sequence as S
from taxaloom.operators import cluster, graph, kmer, textindex, thresholds, windows
from taxaloom.sources import sinks
from tests.test_windows import shuffled


def test_descent(spark):
    r = random.Random(3)
    lineages = {g: [g + 1, g // 2 + 1, g // 4 + 1, 1] for g in range(8)}
    matrix = [(k, i, j, r.gauss(10 - 2 * next(x for x in range(4) if lineages[i][x] == lineages[j][x]), 1)) for k in range(2) for i in range(8) for j in range(8)]
    stats = thresholds.learned(spark.createDataFrame(matrix, "k int, i int, j int, value double"), spark.createDataFrame(list(lineages.items()), "genome int, l array<int>"), 4)
    bounds = {(x.k, x.genome): (x.means, x.upper) for x in thresholds.boundaries(stats, 4).collect()}
    cands = [(r.randrange(2), r.randrange(9), r.uniform(0, 13), r.randrange(3)) for _ in range(200)]
    got = {(x.k, x.genome, x.score, x.level): (x.by_boundary, x.by_mean) for x in thresholds.descended(spark.createDataFrame(cands, "k int, genome int, score double, level int"), thresholds.boundaries(stats, 4), 4).collect()}
    for k in range(2):
        for g in range(8):
            values = {lv: [v for kk, i, j, v in matrix if kk == k and i == g and next(x for x in range(4) if lineages[i][x] == lineages[j][x]) == lv] for lv in range(4)}
            means, upper = bounds[k, g]
            assert np.allclose(means, [np.mean(values[lv]) for lv in range(4)])
            for lv in range(3):
                m1, m2, s1, s2 = np.mean(values[lv]), np.mean(values[lv + 1]), np.std(values[lv]), np.std(values[lv + 1])
                assert min(m1, m2) <= upper[lv] <= max(m1, m2)
                if s1 > 0 and s2 > 0 and abs(upper[lv] - (m1 + m2) / 2) > 1e-9:
                    f = lambda x, m, s, n: n * math.exp(-((x - m) ** 2) / (2 * s * s)) / s
                    assert math.isclose(f(upper[lv], m1, s1, len(values[lv])), f(upper[lv], m2, s2, len(values[lv + 1])), rel_tol=1e-6)
    for k, g, score, level in cands:
        means, upper = bounds.get((k, g), (None, None))
        a = b = level
        if means:
            for lv in range(level, 3):
                if upper[lv] is not None and score >= upper[lv]:
                    break
                a = lv + 1
            for lv in range(level, 3):
                if score >= means[lv]:
                    if lv > 0 and score >= 0.8 * means[lv - 1]:
                        b = lv - 1
                    break
                b = lv + 1
        assert got[k, g, score, level] == (a, b)


def test_extended_reads(spark):
    r = random.Random(6)
    core = "".join(r.choices("ACGT", k=40))
    texts = [(i, "".join(r.choices("ACGT", k=r.randrange(0, 12))) + core[r.randrange(8) : r.randrange(15, 40)] + "".join(r.choices("AC", k=10))) for i in range(30)] + [(90, ""), (91, "AC")]
    reads = [(j, "".join(c if r.random() > 0.1 else "T" for c in core[r.randrange(6) : 36])) for j in range(10)] + [(50, ""), (51, "ACGTA")]
    k, ext, more = 5, 6, 3
    want = {}
    for j, s in reads:
        last = {s[p : p + k]: s[max(p - ext, 0) : p] for p in range(len(s) - k + 1)}
        n = 0
        for x, before in last.items():
            if not any(x in t for _, t in texts):
                continue
            for ch in reversed(before):
                if any(ch + x in t for _, t in texts):
                    x = ch + x
            n += sum(x in t for _, t in texts) > more
        if n:
            want[j] = n
    out = textindex.classify_extended(spark.createDataFrame(reads, "id long, s string"), spark.createDataFrame(texts, "id long, s string"), k, ext, more, "id")
    assert {x.id: x.n for x in out.collect()} == want and want


def plain_extended(reads, texts, k, ext, more):
    """texts: (owner, s), where rows may share an owner."""
    owners = lambda x: len({i for i, t in texts if t and x in t})
    want = {}
    for j, s in reads:
        n = 0
        for x, before in {s[p : p + k]: s[max(p - ext, 0) : p] for p in range(len(s or "") - k + 1)}.items():
            if owners(x):
                for ch in reversed(before):
                    x = ch + x if owners(ch + x) else x
            n += owners(x) > more
        if n:
            want[j] = n
    return want


@pytest.mark.parametrize("k,ext,shared", [(4, 0, False), (4, 5, True), (6, 12, False), (8, 30, True)])
def test_extended_reads_of_other_characters(spark, monkeypatch, k, ext, shared):
    """Other characters than A, C, G and T, empty and null texts, rows that share their owner, small slices, and patterns too long for a number."""
    monkeypatch.setattr(windows, "CHARS", 60)
    r = random.Random(k + ext)
    core = "".join(r.choices("ACGT", k=60)) + "ANCÑGNT" + "".join(r.choices("ACGT", k=40))
    part = lambda p: "".join(c if r.random() > p else r.choice("TN") for c in core[r.randrange(60) : r.randrange(60, 107)])
    texts = [(i % 20 if shared else i, part(0.05)) for i in range(40)] + [(90, ""), (91, None), (92, "AC")]
    reads = [(j, part(0.1)) for j in range(15)] + [(50, ""), (51, None), (52, core[:3])]
    out = textindex.classify_extended(spark.createDataFrame(reads, "id long, s string"), spark.createDataFrame(texts, "id long, s string").coalesce(2), k, ext, 3, "id")
    want = plain_extended(reads, texts, k, ext, 3)
    assert {x.id: x.n for x in out.collect()} == want and want


def test_extended_reads_shuffle_little(spark):
    """Windows of the index that no read asks for are not exchanged: 400 texts of 5,000 bases shuffle less than 0.4 bytes a base."""
    r = random.Random(5)
    texts = spark.createDataFrame([(i, "".join(r.choices("ACGT", k=5000))) for i in range(400)], "id long, s string")
    reads = spark.createDataFrame([(1, "".join(r.choices("ACGT", k=300)))], "id long, s string")
    before = shuffled(spark)
    textindex.classify_extended(reads, texts, 8, 12, 2, "id").collect()
    assert shuffled(spark) - before < 800_000


def plain_spearman(vectors, starts, merge, rounds=20):
    def ranks(v):
        return np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])

    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) > 1e-12 else x * 0
    u = {i: unit(ranks(v) - (len(v) + 1) / 2) for i, v in vectors}
    best = (math.inf, None)
    for first in starts:
        centres, before = [u[i] for i in first], math.inf
        for _ in range(rounds):
            at = {i: max(range(len(centres)), key=lambda c: (round(float(x @ centres[c]), 9), -c)) for i, x in u.items()}
            far = sum(1 - round(float(x @ centres[at[i]]), 9) for i, x in u.items())
            if far < best[0] - 1e-7:
                best = far, centres
            if far >= before - 1e-9:
                break
            before = far
            centres = [unit(sum((u[i] for i in u if at[i] == c), np.zeros(len(x0)))) if any(a == c for a in at.values()) else x0 for c, x0 in enumerate(centres)]
    at = {i: max(range(len(best[1])), key=lambda c: (round(float(x @ best[1][c]), 9), -c)) for i, x in u.items()}
    groups = {c: [i for i in u if at[i] == c] for c in set(at.values())}
    into = {c: c for c in groups}
    sums = {c: sum(u[i] for i in m) for c, m in groups.items()}
    while True:
        pairs = [(-round(float(unit(sums[a]) @ unit(sums[b])), 9), a, b) for a in sums for b in sums if a < b]
        if not pairs or -min(pairs)[0] < merge:
            return {i: (at[i], into[at[i]]) for i in u}
        _, a, b = min(pairs)
        sums[a] = sums[a] + sums.pop(b)
        into = {c: a if x == b else x for c, x in into.items()}


def test_spearman_clusters(spark):
    r = np.random.default_rng(8)
    base = r.random((4, 30))
    vectors = [(i, [float(x) for x in np.round(base[i % 4] + r.normal(0, 0.02 + 0.1 * (i % 4 == 3), 30), 2)]) for i in range(200)] + [(900, [1.0] * 30)]
    df = spark.createDataFrame(vectors, "id long, v array<double>").repartition(4)
    from pyspark.sql import functions as F

    starts = [[x.id for x in df.orderBy(F.xxhash64(F.lit(7 + s), "id"), "id").limit(8).collect()] for s in range(2)]
    out = cluster.spearman_clusters(df, "id", "v", 8, 0.97, restarts=2)
    got = {x.id: (x.cluster, x.merged) for x in out.collect()}
    assert got == plain_spearman(vectors, starts, 0.97)
    assert len({m for _, m in got.values()}) < len({c for c, _ in got.values()})
    assert cluster.spearman_clusters(df.limit(0), "id", "v", 8, 0.97).count() == 0


@pytest.mark.parametrize(("seed", "n", "small"), [(1, 40, 200_000), (2, 8, 3)])
def test_ordered_merging(spark, monkeypatch, seed, n, small):
    monkeypatch.setattr(graph, "PART_EDGES", small)
    r = random.Random(seed)
    limit = 60
    lengths = {i: r.choice([5, 10, 30, 70]) for i in range(n)}
    edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(3 * n // 2)})
    weights = {e: r.randrange(1, 6) for e in edges}
    total = {i: sum(w for e, w in weights.items() if i in e) for i in range(n)}
    root = {i: i for i in range(n)}

    def find(i):
        return i if root[i] == i else find(root[i])

    size = dict(lengths)
    passes = ((0.6, False), (0.3, True), (0.1, True))
    for ratio, guarded in passes:
        for (u, v), w in sorted(weights.items()):
            a, b = find(u), find(v)
            if w / max(total[u], total[v]) < ratio or a == b or guarded and size[a] > limit and size[b] > limit:
                continue
            root[max(a, b)] = min(a, b)
            size[min(a, b)] = size[a] + size[b]
    out = graph.merge_in_order(spark.createDataFrame([(u, v, w) for (u, v), w in weights.items()], "u long, v long, w long"), spark.createDataFrame(list(lengths.items()), "node long, length long"), passes, limit)
    assert {x.node: x.comp for x in out.collect()} == {i: find(i) for i in range(n) if total[i]}


def test_bucketed_index(spark):
    """A join on the bucketed index shuffles the probes alone, before and after genomes are added."""
    r = random.Random(2)
    make = lambda ids: spark.createDataFrame([(i, "".join(r.choices("ACGT", k=200))) for i in ids], "item_id long, s string")
    one, two = make(range(5)), make(range(5, 9))
    sinks.kmer_index(kmer.kmer_index(one, 6, "item_id"), "kmers_of_genomes", 8)
    owners = make(range(20)).withColumnRenamed("item_id", "doc_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for known in (one, one.union(two)):
            hits = kmer.pair_hits(owners, spark.table("kmers_of_genomes"), 6, "doc_id")
            assert {tuple(x) for x in hits.collect()} == {tuple(x) for x in kmer.pair_hits(owners, kmer.kmer_index(known, 6, "item_id"), 6, "doc_id").collect()}
            plan = hits._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.rindex("SortMergeJoin") :] if "SortMergeJoin" in plan else plan[plan.rindex("ShuffledHashJoin") :]
            assert join.count("Exchange") == 1 and "Bucketed: true" in join
            sinks.extend_kmer_index(kmer.kmer_index(one.union(two), 6, "item_id"), "kmers_of_genomes", 8)
        assert spark.table("kmers_of_genomes").count() == kmer.kmer_index(one.union(two), 6, "item_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table kmers_of_genomes")


def test_fronts(spark):
    df = spark.createDataFrame([(0, "ACGTAC"), (1, "AC"), (2, "")], "id long, s string")
    got = {(x.id, x.kmer) for x in kmer.suffix_index(df, [2, 4], "id").collect()}
    assert got == {(i, s[p : p + k]) for i, s in ((0, "ACGTAC"), (1, "AC")) for k in (2, 4) for p in range(len(s) - k + 1)}
    assert S.CHUNK == 128

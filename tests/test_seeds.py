"""Seed and verify against brute force, and its shuffle under a repeat."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taxaloom.operators import mapping, seeds


def brute(a, b, k, where):
    out = set()
    for i, s in a:
        for j, t in b:
            shared = {p - q for p in range(len(s) - k + 1) for q in range(len(t) - k + 1) if s[p : p + k] == t[q : q + k]}
            for d in shared:
                if where(i, j, len(s), len(t), d):
                    lo, hi = max(d, 0), min(d + len(t), len(s))
                    same = sum(s[x] == t[x - d] for x in range(lo, hi))
                    out.add((i, j, d, same, hi - lo - same))
    return out


@pytest.mark.parametrize(("piece", "tile"), [(256, 2048), (16, 3)])
def test_brute_force(spark, monkeypatch, piece, tile):
    monkeypatch.setattr(seeds, "PIECE", piece)
    monkeypatch.setattr(seeds, "TILE", tile)
    r = random.Random(4)
    unit = "".join(r.choices("ACGT", k=30))
    a = [(i, "".join(r.choices("ACGT", k=r.randrange(0, 300))) + unit * r.randrange(0, 4) + "A" * r.randrange(0, 40)) for i in range(12)]
    b = [(j, (unit * 2)[r.randrange(20) : r.randrange(21, 55)] + "".join(r.choices("ACGT", k=r.randrange(0, 60)))) for j in range(20)]
    b += [(20 + j, a[j][1][5:200]) for j in range(4)] + [(30, ""), (31, "ACG"), (32, "A" * 25)]
    one, two = spark.createDataFrame(a, "u long, s string"), spark.createDataFrame(b, "v long, s string").repartition(3)
    got = seeds.seeded(one, two, ["u"], ["v"], 8).collect()
    rows = [(x.u, x.v, x.d, x["match"], x.mismatch) for x in got]
    assert len(rows) == len(set(rows)) and set(rows) == brute(a, b, 8, lambda *_: True)
    inside = seeds.seeded(one, two, ["u"], ["v"], 8, "d >= 0 and d + nb <= na").collect()
    assert {(x.u, x.v, x.d, x["match"], x.mismatch) for x in inside} == brute(a, b, 8, lambda i, j, m, n, d: d >= 0 and d + n <= m)


@pytest.mark.parametrize(("held", "part", "step"), [(1 << 22, 1 << 20, 1 << 22), (1 << 22, 7, 50), (0, 0, 0)])
def test_ways_agree(spark, monkeypatch, held, part, step):
    """Broadcast and shuffled, whole and in parts: the same rows as brute force, with other characters and null too."""
    for name, value in (("HELD", held), ("PART", part), ("STEP", step)):
        monkeypatch.setattr(seeds, name, value)
    r = random.Random(6)
    unit = "".join(r.choices("ACGT", k=30))
    a = [(i, "".join(r.choices("ACGT", k=r.randrange(0, 300))) + unit * r.randrange(0, 4) + "A" * r.randrange(0, 40)) for i in range(12)] + [(50, "ÑACGTNNACGTACGTÑÑACGNT"), (51, "\U0001d49e" + unit)]
    b = [(j, (unit * 2)[r.randrange(20) : r.randrange(21, 55)] + "".join(r.choices("ACGT", k=r.randrange(0, 60)))) for j in range(20)]
    b += [(20 + j, a[j][1][5:200]) for j in range(4)] + [(30, ""), (31, "ACG"), (32, "A" * 25), (33, "ACGTACGTÑÑACGNTC"), (34, "\U0001d49e" + unit[:20])]
    one, two = spark.createDataFrame([*a, (60, None)], "u long, s string"), spark.createDataFrame([*b, (61, None)], "v long, s string").repartition(3)
    got = seeds.seeded(one, two, ["u"], ["v"], 8).collect()
    rows = [(x.u, x.v, x.d, x["match"], x.mismatch) for x in got]
    assert len(rows) == len(set(rows)) and set(rows) == brute(a, b, 8, lambda *_: True)


def test_small_side_shuffles_nothing(spark):
    r = random.Random(2)
    contigs = [(i, "".join(r.choices("ACGT", k=1000))) for i in range(50)]
    reads = [(j, contigs[j % 50][1][j : j + 60]) for j in range(400)]
    one, two = spark.createDataFrame(contigs, "ctg_id long, s string"), spark.createDataFrame(reads, "read_id long, s string")
    before = shuffled(spark)
    assert seeds.seeded(one, two, ["ctg_id"], ["read_id"], 12).where("match = 60").select("read_id").collect()
    assert shuffled(spark) - before < 2000


def test_both_strands(spark):
    r = random.Random(9)
    contigs = [(i, "".join(r.choices("ACGT", k=900))) for i in range(3)]
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads, want = [], {}
    for j in range(60):
        c, p, strand = r.randrange(3), r.randrange(800), r.randrange(2)
        s = contigs[c][1][p : p + 100]
        if j % 3 == 0:
            s = s[:50] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[50]] + s[51:]
        reads.append((j, back(s) if strand else s))
        want[j] = (c, p, strand, 100 - (j % 3 == 0))
    out = mapping.map_both_strands(spark.createDataFrame(reads, "read_id long, s string"), spark.createDataFrame(contigs, "ctg_id long, s string"), 12, F.col("score") >= 95)
    assert {x.read_id: (x.ctg_id, x.pos, x.strand, x.score) for x in out.collect()} == want


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_repeat_in_a_long_contig(spark):
    """A contig of 1,000,000 bases with 20 copies of a repeat, and 10,000 reads of it: the shuffle stays below 60 bytes for each candidate base pair's piece
    and each seed, and below 60 times the input."""
    r = random.Random(1)
    unit = "".join(r.choices("ACGT", k=1000))
    rest = ["".join(r.choices("ACGT", k=49_000)) for _ in range(20)]
    contig = "".join(x + unit for x in rest)
    reads = [(j, unit[(p := r.randrange(900)) : p + 100]) for j in range(10_000)]
    one, two = spark.createDataFrame([(0, contig)], "ctg_id long, s string"), spark.createDataFrame(reads, "read_id long, s string").repartition(8)
    before = shuffled(spark)
    out = mapping.map_reads(two, one, 12, F.col("score") >= 95)
    rows = out.collect()
    assert len(rows) == 10_000 and all(x.score == 100 and x.pos < 50_000 for x in rows)
    size = len(contig) + 100 * len(reads)
    assert shuffled(spark) - before < 60 * size, (shuffled(spark) - before) / size

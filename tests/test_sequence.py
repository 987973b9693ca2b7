from __future__ import annotations

import random

from pyspark.sql import functions as F

from taxaloom.functions import sequence as S


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(expr.alias("r")).first().r


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="ACGTNacgt") == "NNNNNACGT"
    s = "".join(random.Random(1).choices("ACGT", k=200))
    assert one(spark, S.reverse_complement(S.reverse_complement(F.col("s"))), s=s) == s


def test_kmers(spark):
    assert one(spark, S.kmers(F.col("s"), 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, S.kmers(F.col("s"), 3), s="AC") == []
    assert {tuple(x) for x in one(spark, S.canonical_pairs(F.col("s"), 3), s="ACGTA")} == {("ACG", "CGT"), ("GTA", "TAC")}


def test_canonical_is_strand_invariant(spark):
    s = "".join(random.Random(2).choices("ACGT", k=120))
    a = one(spark, S.canonical_pairs(F.col("s"), 7), s=s)
    b = one(spark, S.canonical_pairs(S.reverse_complement(F.col("s")), 7), s=s)
    assert set(map(tuple, a)) == set(map(tuple, b))


def test_fragments(spark):
    f = one(spark, S.fragments(F.col("s"), 4), s="ACGTACGTA")
    assert [tuple(x) for x in f] == [(0, "ACGT"), (1, "ACGT"), (2, "A")]
    assert [tuple(x) for x in one(spark, S.fragments(F.col("s"), 4), s="")] == [(0, "")]


def test_codons(spark):
    assert [one(spark, S.residue(F.col("s")), s=c) for c in ("ATG", "TAA", "ATN")] == ["M", "*", "X"]
    assert one(spark, S.translate_codons(F.col("s")), s="ATGTAAAT") == "M*"
    assert one(spark, S.translate_codons(F.col("s")), s="AT") == ""
    assert one(spark, S.codon_symbols(F.col("s")), s="ACT") == [7]
    assert one(spark, S.codon_symbols(F.col("s"), legacy=True), s="ACTTCA") == [6, 7]


def test_small_functions(spark):
    assert one(spark, S.binomial_bound(F.col("i")), i=100) == 96
    assert one(spark, S.packed_id(F.col("g"), F.col("e")), g=1, e=2) == 65538
    assert one(spark, S.genome_of(F.col("x")), x=65538) == 1
    assert one(spark, S.split_names(F.col("s"), ";"), s="a;b;") == ["a", "b"]
    assert one(spark, S.unique_names(F.array(F.lit("a"), F.lit("a")))) == ["a", "a1"]
    assert tuple(one(spark, S.overlap(F.col("a"), F.col("b"), F.lit(2)), a="ACGTA", b="GTCC")) == (2, 1)


def test_long_sequences(spark):
    """Over chunk borders the k-mers and residues are those of the whole sequence, in time linear in the length."""
    import random
    import time

    r = random.Random(3)
    for n in (0, 2, 5, 127, 128, 129, 132, 133, 383, 384, 385, 387, 1000):
        t = "".join(r.choice("ACGTN") for _ in range(n))
        assert one(spark, S.kmers(F.col("s"), 6), s=t) == [t[i : i + 6] for i in range(n - 5)]
        index = {c: i for i, c in enumerate("ACGT")}
        codons = [t[i : i + 3] for i in range(0, n - 2, 3)]
        assert one(spark, S.translate_codons(F.col("s")), s=t) == "".join("X" if "N" in c else S.GENETIC_CODE[16 * index[c[0]] + 4 * index[c[1]] + index[c[2]]] for c in codons)
    long = "".join(r.choice("ACGT") for _ in range(16_000))
    one(spark, F.size(S.canonical_pairs(F.col("s"), 12)), s=long)
    start = time.time()
    assert one(spark, F.size(S.canonical_pairs(F.col("s"), 12)), s=long) > 15_000
    assert time.time() - start < 5

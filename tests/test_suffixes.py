"""Suffix ranks, common prefixes and substrings of sets against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taxaloom.operators import suffixes
from taxaloom.scratch import Scratch


def made(seed):
    r = random.Random(seed)
    texts = ["", "A", "ACA", "A" * 40, "AB" * 20, "".join(r.choices("ACGT", k=200)), "ACGTTGCA" * 5 + "C" + "ACGTTGCA" * 4, "".join(r.choices("AC", k=150))]
    return list(enumerate(texts))


def test_order_bwt_and_prefixes(spark):
    texts = made(1)
    df = spark.createDataFrame(texts, "id long, s string")
    got = {k: [] for k, _ in texts}
    for r in suffixes.suffix_order(df, "id").collect():
        got[r.id].append((r.rank, r.pos))
    bwts = {r.id: r.bwt for r in suffixes.bwt(df, "id").collect()}
    depths = {(r.id, r.end_pos): r.depth for r in suffixes.lcp_depth(df, "id").collect()}
    want = {}
    for k, s in texts:
        order = sorted(range(len(s) + 1), key=lambda p: s[p:])
        assert [p for _, p in sorted(got[k])] == order and [r for r, _ in sorted(got[k])] == list(range(len(s) + 1))
        assert bwts[k] == "".join(s[p - 1] if p else "$" for p in order)
        for a, b in zip(order, order[1:]):
            n = next((i for i in range(len(s) - max(a, b)) if s[a + i] != s[b + i]), len(s) - max(a, b))
            if n:
                want[k, b + n - 1] = max(n, want.get((k, b + n - 1), 0))
    assert depths == want


def plain_sets(groups, least, first=False):
    out = set()
    for g, members in groups.items():
        for m, s in members[:1] if first else members:
            size = [max((n for n in range(len(s) - p + 1) if all(s[p : p + n] in t for _, t in members)), default=0) for p in range(len(s))]
            out |= {(g, m, p, n) for p, n in enumerate(size) if n >= least and (p == 0 or size[p - 1] <= n)}
    return out


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_sets(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    r = random.Random(block)
    core = "".join(r.choices("ACGT", k=20))
    groups = {g: [(m, "".join(r.choices("ACGT", k=r.randrange(0, 40))) + core[r.randrange(3) : r.randrange(12, 20)] + "".join(r.choices("AC", k=r.randrange(0, 30)))) for m in range(n)] for g, n in enumerate([1, 2, 3, 5])}
    groups |= {8: [(0, "AAAA"), (1, "AAAA"), (2, "AAAAAA")], 9: [(0, ""), (4, "ACGT")], 10: [(3, "ACG")]}
    df = spark.createDataFrame([(g, m, s) for g, ms in groups.items() for m, s in ms], "g long, m long, s string")
    got = {tuple(x) for x in suffixes.set_substrings(df, "g", "m", 2, everywhere=True).collect()}
    assert got == plain_sets(groups, 2)
    first = {tuple(x) for x in suffixes.set_substrings(df, "g", "m", 2).collect()}
    assert first == {(g, p, n) for g, m, p, n in got if m == groups[g][0][0]}


def test_a_set_of_200_members(spark):
    r = random.Random(5)
    core = "".join(r.choices("ACGT", k=60))
    members = [(m, "".join(r.choices("ACGT", k=r.randrange(5, 90))) + core + "".join(r.choices("ACGT", k=r.randrange(5, 90)))) for m in range(200)]
    df = spark.createDataFrame([(0, m, s) for m, s in members], "g long, m long, s string")
    got = {tuple(x) for x in suffixes.set_substrings(df, "g", "m", 10).collect()}
    assert got == {(g, p, n) for g, m, p, n in plain_sets({0: members}, 10, first=True)} and len(got) >= 1


def test_a_long_text(spark):
    """1,000,000 characters with a long repeat: the order is checked by comparing neighbours, and what is written stays far below the square."""
    r = random.Random(2)
    part = "".join(r.choices("ACGT", k=500))
    s = part + "".join(r.choices("ACGT", k=999_000)) + part
    with Scratch(spark) as space:
        o = suffixes.ordered(spark.createDataFrame([(0, 0, s)], "owner long, member long, s string"), space)
        assert o.order.agg(F.count_distinct("rank"), F.max("rank")).first() == (1_000_001, 1_000_000)
        order = [x.pos for x in o.order.orderBy("rank").where("rank % 997 in (0, 1)").collect()]
    assert all(s[a : a + 600] <= s[b : b + 600] for a, b in zip(order, order[1:]))

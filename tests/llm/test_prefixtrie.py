from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from taxaloom.llm import oracles, prefixtrie
from taxaloom.llm.queries import op12_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie by plain dictionaries; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += children[node] == 0
    return sorted((m[0], len(x), members[x[:-1]][0] if x else None, len(m), children[x], leaves[x], saved[x], hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest()) for x, m in members.items())


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def made(seed, n, ids):
    r = random.Random(seed)
    rows = []
    for c in ids(r, n):
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([None, t, t, t, 3]), r.choice(["user", "user", None]), r.choice(["hi", "hello there", "", None, "é漢"])))
    return rows + rows[:7]


SCHEMA = "conv_id long, turn long, role string, text string, depth int, shard string"


def test_brute_force(spark):
    for seed, n, ids in ((1, 260, lambda r, n: range(n)), (2, 90, lambda r, n: [100 * r.randrange(40) + r.randrange(4) for _ in range(n)]), (3, 60, lambda r, n: [r.randrange(1 << 40) for _ in range(n)] + [0, 100, None])):
        rows = made(seed, n, ids)
        df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA).repartition(5)
        assert collected(prefixtrie.conversation_trie(df)) == brute(rows)
    assert prefixtrie.conversation_trie(df.limit(0)).count() == 0


def test_long_and_hot(spark):
    """A conversation over many bands, a copy of it that leaves late, one that stops in between, and a first turn that many share."""
    long = [(100, t, "user", f"turn {t}") for t in range(333)]
    rows = long + [(200, t, "user", f"turn {t}") for t in range(300)] + [(300, t, "user", "other" if t == 250 else f"turn {t}") for t in range(333)]
    rows += [(c, t, "user", "same" if t == 0 else f"{c % 7}") for c in range(1000, 4000) for t in range(c % 3 + 1)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)
    assert collected(prefixtrie.conversation_trie(df)) == brute(rows)


def test_groups_are_bounded(spark):
    convs = spark.range(5000).selectExpr("id * 977 as conv_id", "1L as n")
    sizes = [r["count"] for r in prefixtrie.shards(convs).groupBy("shard").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= prefixtrie.SHARD


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(op12_prefix_trie(spark, sf))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted((tuple(None if x is None else x for x in r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.TRIE})").fetchall()), key=lambda r: r[:2]) == got

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from taxaloom.operators import cluster, graph, kmer, mapping, report, stats, suffixes, taxonomy, textindex


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fractional_hits(spark):
    c = spark.createDataFrame([(1, "ACG")], "doc int, s string")
    t = spark.createDataFrame([("a", "ACG"), ("b", "ACG")], "item string, s string")
    hits = kmer.pair_hits(c, kmer.kmer_index(t, 3, "item"), 3, "doc")
    assert rows(kmer.fractional_hits(hits, ["doc"], ["item"])) == [(1, "a", 0.5), (1, "b", 0.5)]


def test_palindrome_counts_once(spark):
    c = spark.createDataFrame([(1, "ACGT")], "doc int, s string")
    hits = kmer.pair_hits(c, kmer.kmer_index(c.select(F.col("doc").alias("item"), "s"), 4, "item"), 4, "doc")
    assert rows(kmer.unit_hits(hits, "doc", "item")) == [(1, 1, 1)]


def test_argmax_tie(spark):
    s = spark.createDataFrame([(0, 3, 5.0), (0, 1, 5.0)], "c int, sid int, score double")
    assert rows(kmer.best(s, "c", "sid")) == [(0, 1, 5.0)]


def test_region_lookup(spark):
    r = spark.createDataFrame([(0, 3, 1), (0, 7, 2), (0, 9, 3)], "k int, end long, lab long")
    p = spark.createDataFrame([(0, 0), (0, 3), (0, 5), (0, 9)], "k int, pos long")
    assert rows(graph.region_of(p, r, "k", "pos", "end", "lab")) == [(0, 0, 1), (0, 3, 2), (0, 5, 2), (0, 9, 3)]


def test_islands(spark):
    i = spark.createDataFrame([(0, 1, 3), (0, 2, 6), (0, 8, 10), (0, 2, 3)], "k int, a int, b int")
    assert rows(graph.islands(i, "k", "a", "b")) == [(0, 1, 6), (0, 8, 10)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (99, 99)]
    c = dict(rows(graph.components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(c[i] == 1 for i in range(1, 41)) and c[70] == 50 and 99 not in c
    assert rows(graph.components(spark.createDataFrame([], "u long, v long"))) == []


def test_pair_ratio(spark):
    e = spark.createDataFrame([(1, 2, 3), (2, 3, 1)], "u long, v long, w long")
    assert rows(graph.node_weights(e)) == [(1, 3, 1), (2, 4, 2), (3, 1, 1)]
    n = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "node long, length long")
    assert {c for _, c in rows(graph.merge_by_ratio(e, n, ((0.25, False),), 10))} == {1}


def test_entropy(spark):
    n = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "k int, v int, n long")
    (k, e, m), = rows(stats.entropy_majority(n, ["k"], "v"))
    assert (k, m) == (0, 1) and math.isclose(e, 0.636514, abs_tol=1e-6)
    (_, l2, top, gap), = rows(stats.composition(n, "k"))
    assert math.isclose(l2, -0.918296, abs_tol=1e-6) and math.isclose(top, 2 / 3) and math.isclose(gap, 1 / 3)


def test_lca(spark):
    t = spark.createDataFrame([(0, [11, 5, 2]), (0, [12, 5, 2]), (1, [1, 2, 3]), (1, [2, 3, 4])], "k int, l array<int>")
    assert rows(taxonomy.lca(t, "k", "l", 3)) == [(0, 1, 5), (1, 99, 0)]


def test_tree(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("b", "z")], "parent string, child string")
    assert dict(rows(taxonomy.postorder(e))) == {"x": 0, "y": 1, "a": 2, "z": 3, "b": 4, "r": 5}
    assert dict(rows(taxonomy.leaf_counts(e))) == {"a": 2, "b": 1, "r": 3}
    assert dict(rows(taxonomy.heavy_paths(e))) == {"r": "r", "a": "r", "x": "r", "y": "y", "b": "b", "z": "b"}


def test_suffixes_and_bwt(spark):
    t = spark.createDataFrame([(0, "ACA")], "k int, s string")
    assert [r[2] for r in sorted(suffixes.suffix_order(t, "k").select("k", "rank", "pos").collect(), key=lambda r: r[1])] == [3, 2, 0, 1]
    assert rows(suffixes.bwt(t, "k")) == [(0, "AC$A")]
    b = "AC$A"
    order = [""] * len(b)
    for _ in b:  # inverting gives the text back
        order = sorted(c + x for c, x in zip(b, order, strict=True))
    assert next(x for x in order if x.endswith("$")) == "ACA$"


def test_reports(spark):
    c = spark.createDataFrame([(0, 1, "AC"), (0, 2, "GT")], "g int, id int, s string")
    assert rows(report.virtual_contigs(c, "g", "id", 3)) == [(0, "1_2", "ACNNNGT")]


def test_confidence(spark):
    v = spark.createDataFrame([(0, 1.0)], "u int, v double")
    level = lambda *x: spark.createDataFrame(x, "level string, mean double, sd double, weight double")
    c = rows(stats.gaussian_confidence(v, "u", "v", level(("b", 3.0, 1.0, 1.0), ("a", -1.0, 1.0, 1.0))))
    assert [x[1] for x in c] == ["a", "b"] and math.isclose(c[0][2], 0.5) and math.isclose(c[1][2], 1.0)
    c = rows(stats.gaussian_confidence(v, "u", "v", level(("a", 0.0, 1.0, 1.0), ("b", 2.0, 1.0, 1.0), ("c", 2.0, 0.0, 1.0))))
    assert c[0][2] == 0 and math.isclose(c[1][2], 1.0) and math.isclose(c[2][2], 1.0)


def test_fixed_target(spark):
    s = spark.createDataFrame([("x", 1, 5), ("x", 2, 9), ("y", 3, 4), (None, 1, 2)], "c string, sid int, score long")
    f = spark.createDataFrame([("x", 1, 7), (None, 8, 1)], "c string, sid int, score long")
    assert {tuple(r) for r in kmer.best_or_fixed(s, f, "c", "sid").collect()} == {("x", 1, 7), ("y", 3, 4), (None, 8, 1)}


def test_confusion_matrix(spark):
    c = spark.createDataFrame([(1, 0, 5), (1, 2, 6), (2, 1, 7)], "ref long, pred long, n long")
    assert rows(stats.confusion_matrix(c, 3)) == [(1, 5, 0, 6), (2, 0, 7, 0)]


def test_kmeans_and_merge(spark):
    v = spark.createDataFrame([(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(20)], "id int, e array<double>")
    assert cluster.kmeans(v, 2, "e").select("cluster").distinct().count() == 2
    assert cluster.iterative_merge(v, "e", 6, 0.95).select("cluster").distinct().count() == 2


def test_qmer_clusters(spark):
    """Contigs of two compositions fall apart, whatever their strand and length."""
    r = random.Random(3)
    seq = lambda kind, n: "".join(r.choices("ACGT", weights=(5, 1, 1, 5) if kind else (1, 5, 5, 1), k=n))
    c = spark.createDataFrame([(i, seq(i % 2, 300 + 10 * i)) for i in range(30)] + [(99, "AC")], "id int, s string")
    v = cluster.qmer_vectors(c, 3, "id")
    profiles = {x.id: x.profile for x in v.collect()}
    assert sorted(profiles) == list(range(30)) and all(len(p) == 32 and math.isclose(sum(p), 1) for p in profiles.values())
    got = {x.id: x.cluster for x in cluster.kmeans(v, 2, "profile", restarts=3).collect()}
    assert len({got[i] for i in range(0, 30, 2)}) == 1 and len({got[i] for i in range(1, 30, 2)}) == 1 and got[0] != got[1]


def test_common_substrings(spark):
    r = random.Random(4)
    texts = {g: ["".join(r.choices("ACGT", k=r.randint(0, 30))) for _ in range(3)] for g in range(12)}
    texts[99] = ["ACGTACGT"]
    df = spark.createDataFrame([(g, m, s) for g, x in texts.items() for m, s in enumerate(x)], "g int, m int, s string")
    want = []
    for g, x in texts.items():
        size = [max(n for n in range(len(x[0]) - p + 1) if all(x[0][p : p + n] in s for s in x)) for p in range(len(x[0]))]
        want += [(g, p, n) for p, n in enumerate(size) if n >= 2 and (p == 0 or size[p - 1] <= n)]
    assert rows(suffixes.set_substrings(df, "g", "m", 2)) == sorted(want)


def test_common_prefixes_of_suffixes(spark):
    texts = ["ACACACAC", "", "A", "GATTACAGATTACA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    want = {}
    for i, t in enumerate(texts):
        order = sorted(t[p:] for p in range(len(t) + 1))
        for a, b in zip(order, order[1:], strict=False):
            n = next((k for k in range(len(a) + 1) if k == len(a) or a[k] != b[k]))
            if n:
                end = len(t) - len(b) + n - 1
                want[i, end] = max(n, want.get((i, end), 0))
    assert {(x.id, x.end_pos): x.depth for x in suffixes.lcp_depth(df, "id").collect()} == want


def test_pair_mapping(spark):
    m = [(1, 0, 5, 9), (1, 1, 6, 9), (2, 0, 5, 9), (2, 1, 5, 9), (3, 0, None, 4), (3, 1, 5, 9), (4, 0, 5, 9), (4, 1, None, 4), (5, 0, None, 1), (5, 1, None, 2), (6, 0, None, 1)]
    df = spark.createDataFrame(m, "pair int, mate int, target int, score int")
    got = {(x.kind, x.score): x.n for x in mapping.pair_mapping(df, "pair", "mate", "target", "score").collect()}
    assert got == {("mixed", None): 1, ("half", 4): 2, ("unmapped", None): 1}


def test_mapping(spark):
    c = spark.createDataFrame([(1, "ACGTACGGTTCA"), (2, "GGGGACGTACGATT")], "ctg_id int, s string")
    r = spark.createDataFrame([(7, "ACGTACGG"), (8, "CGTACGAT")], "read_id int, s string")
    got = rows(mapping.map_reads(r, c, 4, F.col("score") >= 7))
    assert got == [(7, 1, 0, 8), (8, 2, 5, 8)]
    g = spark.createDataFrame([(7, 8), (7, 9)], "type int, newtype int")
    assert rows(mapping.group_links(g, spark.createDataFrame([(7, 1), (8, 2)], "read_id int, ctg_id int"))) == [(1, 2)]
    x = spark.createDataFrame([(60, 0), (49, 0), (60, 30)], "m int, n int")
    assert [r[0] for r in x.select(mapping.good_overlap(F.col("m"), F.col("n"))).collect()] == [True, False, False]


def test_rank_table(spark):
    n = spark.createDataFrame([(1, 1, "root"), (2, 1, "genus"), (3, 2, "species"), (4, 1, "species")], "tid int, parent int, rank string")
    assert rows(taxonomy.rank_table(n, ["species", "genus"])) == [(1, [0, 0]), (2, [0, 2]), (3, [3, 2]), (4, [4, 0])]


def test_ranked_counts_over_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    got = report.ranked(df, [F.asc("g"), F.desc("v")]).collect()
    want = sorted(((r.g, -r.v) for r in df.collect()))
    assert [(r.g, -r.v) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert report.ranked(df.limit(0), [F.asc("g")]).count() == 0


def test_multi_key_sort_keeps_all_lines(spark, sf):
    from taxaloom.plans import catalog

    assert catalog.QUERIES["multi_key_sort"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() > 100


def test_trees_hold_all_customers(spark, sf):
    from taxaloom.plans import catalog

    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert [catalog.QUERIES[q](spark, sf).count() - n for q in ("postorder", "lineage_array", "rank_lineages")] == [31, 0, 31]


def test_cluster_report_holds_all_targets(spark, sf):
    from taxaloom.plans import catalog

    rows = catalog.QUERIES["cluster_report_sum"](spark, sf).collect()
    by_source = {s: [r for r in rows if r.source == s] for s in {r.source for r in rows}}
    assert all({r.candidates for r in x} == {len(x)} for x in by_source.values()) and max(map(len, by_source.values())) > 10


def test_hits_are_dealt_once(spark):
    """Distinct hits and shares of a pair use one exchange by owner and pair; sums by target the second."""
    owners = spark.createDataFrame([(0, "ACGTACGTTGCAACGT"), (1, "TTTTACGTACG")], "doc_id long, s string").repartition(3)
    index = spark.createDataFrame([("ACGT", 5), ("CGTA", 5), ("TTGC", 6), ("ACGT", 7)], "kmer string, item_id long")
    f = kmer.fractional_hits(kmer.pair_hits(owners, index, 4, "doc_id"), ["doc_id"], ["item_id"])
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 2
    scores = {(r.doc_id, r.item_id): r.score for r in f.collect()}
    assert math.isclose(sum(v for (d, _), v in scores.items() if d == 0), 3.0) and math.isclose(scores[0, 7], 0.5)

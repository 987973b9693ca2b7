"""The annotation operators on the relational tables.

Stand-ins: a document's A, C, G and T are a contig; a benchmark item is a target (gene) of genome item div 4; its taxon
is nation item mod 25 with the lineage (nation + 1, region + 1, 1), 0 meaning a missing rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import cluster, genomes, graph, kmer, mapping, protein, report, stats, suffixes, taxonomy, textindex, thresholds, windows
from ..params import Params
from ..scratch import Scratch, written
from ..sources import readers, sinks
from ..streaming.contigs import annotate

P = Params()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.dna(F.col("text")).alias("s"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", S.dna(F.col("text")).alias("s"))


def index(spark: SparkSession, d: str, k: int = P.k) -> DataFrame:
    return kmer.kmer_index(targets(spark, d), k, "item_id")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """(tid, l) of the taxa."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("tid"), F.array(F.col("n_nationkey").cast("long") + 1, F.col("n_regionkey").cast("long") + 1, F.lit(1).cast("long")).alias("l"))


def fragment_hits(spark: SparkSession, d: str) -> DataFrame:
    return kmer.fragment_hits(contigs(spark, d), index(spark, d), P.k, P.frag_len, "doc_id", "item_id")


def whole_scores(spark: SparkSession, d: str, which: str = "true") -> DataFrame:
    """(doc_id, item_id, score): shares of whole texts' hits among the targets that `which` holds for."""
    return kmer.sum_of_shares(kmer.shared_hits(contigs(spark, d), index(spark, d).where(which), [P.k], ["doc_id"], ["item_id"]), "doc_id", "item_id")


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id, score): the best fragment's hits, all scores."""
    return kmer.unit_hits(fragment_hits(spark, d), "doc_id", "frag", "item_id").groupBy("doc_id", "item_id").agg(F.max("n").alias("score"))


def annotate_contigs(spark, d):
    return annotate(contigs(spark, d), index(spark, d), P.k, P.frag_len, P.hit_threshold, "doc_id", "item_id")


# Scalars


def revcomp(spark, d):
    return contigs(spark, d).select("doc_id", S.reverse_complement(F.col("s")).alias("rc"))


def fragments(spark, d):
    return kmer.fragments(contigs(spark, d), P.frag_len, "doc_id").select("doc_id", F.col("frag").cast("long").alias("frag"), F.length("s").cast("long").alias("size"))


def kmers_canonical(spark, d):
    k = windows.canonical_pairs(contigs(spark, d), ["doc_id"], [8])
    return k.select("doc_id", "a", windows.opposite(F.col("a")).alias("b"))


def translate_six_frames(spark, d):
    f = targets(spark, d).select("item_id", F.explode(S.six_frames(F.col("s"))).alias("f"))
    return f.select("item_id", F.col("f.frame").cast("long").alias("frame"), "f.protein")


def codon_pack(spark, d):
    return targets(spark, d).select("item_id", F.posexplode(S.codon_symbols(F.col("s"))).alias("pos", "symbol")).select("item_id", F.col("pos").cast("long").alias("pos"), "symbol")


def codon_pack_legacy(spark, d):
    return targets(spark, d).select("item_id", F.posexplode(S.codon_symbols(F.col("s"), legacy=True)).alias("pos", "symbol")).select("item_id", F.col("pos").cast("long").alias("pos"), "symbol")


def char_code_bwt(spark, d):
    c = table(spark, d, "benchmark").select("item_id", F.posexplode(S.chars(S.upper_ascii(F.col("text")))).alias("pos", "ch"))
    return c.select("item_id", F.col("pos").cast("long").alias("pos"), S.char_code(F.col("ch")).cast("long").alias("code"))


def base_code_counts(spark, d):
    u = S.upper_ascii(F.col("text"))
    return table(spark, d, "documents").select("doc_id", S.not_acgt(u).cast("long").alias("other"), (F.length(u) - S.not_acgt(u)).cast("long").alias("acgt"))


def split_lineage(spark, d):
    names = S.split_names(F.concat_ws(" ", "p_type", "p_name"), " ")
    p = table(spark, d, "part").select("p_partkey", F.posexplode(F.arrays_zip(names.alias("name"), S.unique_names(names).alias("uniq"))).alias("level", "x"))
    return p.select("p_partkey", F.col("level").cast("long").alias("level"), "x.name", "x.uniq")


def binomial_bound(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("q")).distinct().select("q", S.binomial_bound(F.col("q")).cast("long").alias("bound"))


def cluster_size_estimate(spark, d):
    c = table(spark, d, "documents").select("lang", F.length(S.dna(F.col("text"))).alias("n"))
    return c.groupBy("lang").agg(F.sum("n").alias("total")).select("lang", "total", S.cluster_count(F.col("total"), 300, 2, 200).alias("clusters"))


def substring_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.substring_index("c_name", "#", 1).alias("prefix"), F.substring_index("c_name", "#", -1).cast("long").alias("number"))


def packed_ids(spark, d):
    """Packed target ids and the genome recovered from them."""
    t = table(spark, d, "benchmark").select("item_id", S.packed_id(F.floor(F.col("item_id") / 4).cast("int"), (F.col("item_id") % 4).cast("int")).alias("sid"))
    return t.select("item_id", F.col("sid").cast("long").alias("sid"), S.genome_of(F.col("sid")).cast("long").alias("genome"), F.col("sid").bitwiseAND(65535).cast("long").alias("gene"))


# Scores


def kmer_hits_unit(spark, d):
    return kmer.unit_hits(fragment_hits(spark, d), "doc_id", "frag", "item_id").withColumn("frag", F.col("frag").cast("long"))


def kmer_hits_fractional(spark, d):
    return whole_scores(spark, d).withColumn("score", F.round("score", 6))


def kmer_hits_scoped(spark, d):
    return whole_scores(spark, d, "(item_id % 25) % 5 = 0").withColumn("score", F.round("score", 6))


def multi_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of whole texts at lengths 8 and 12, from one index."""
    ks = [8, 12]
    hits = kmer.shared_hits(contigs(spark, d), kmer.suffix_index(targets(spark, d), ks, "item_id"), ks, ["doc_id"], ["item_id"])
    return hits.withColumn("k", F.length("a").cast("long"))


def kmer_hits_multi_k(spark, d):
    f = kmer.sum_of_shares(multi_hits(spark, d), "doc_id", "k", "item_id")
    return f.select("doc_id", "item_id", "k", F.round("score", 6).alias("score"))


def fragment_flags(spark, d):
    c = contigs(spark, d)
    n = kmer.unit_hits(fragment_hits(spark, d), "doc_id", "frag", "item_id").groupBy("doc_id", "frag").agg(F.max("n").alias("n"))
    f = kmer.fragments(c, P.frag_len, "doc_id").select("doc_id", "frag").join(n, ["doc_id", "frag"], "left")
    return f.select("doc_id", F.col("frag").cast("long").alias("frag"), F.coalesce((F.col("n") >= P.hit_threshold).cast("long"), F.lit(0)).cast("long").alias("flag"))


def frag_bitstring(spark, d):
    return report.bit_strings(fragment_flags(spark, d), "doc_id")


def contig_best_max(spark, d):
    return kmer.best(best_scores(spark, d), "doc_id", "item_id")


def genome_vote(spark, d):
    g = kmer.genome_vote(best_scores(spark, d), "doc_id", "item_id", F.floor(F.col("item_id") / 4).cast("long"))
    return g.withColumn("share", F.round("share", 6))


def freq_kmer_argmax(spark, d):
    return kmer.frequent_kmer_argmax(contigs(spark, d), index(spark, d), P.k, "doc_id", "item_id")


def protein_search(spark, d):
    t = targets(spark, d).select((F.col("item_id") % 25).alias("tid"), "s")
    hits = protein.protein_search(contigs(spark, d), protein.protein_index(t, P.prot_k, "tid"), P.prot_k, "doc_id", "tid")
    return hits.withColumn("score", F.round("score", 6))


# Taxonomy


def lineage_array(spark, d):
    """Lineages with the customers as the lowest rank."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.concat_ws(";", "c_name", "n_name", "r_name").alias("ranks"))


def taxa_hit(spark, d):
    return annotate_contigs(spark, d).withColumn("tid", F.col("item_id") % 25).join(lineage(spark, d), "tid")


def lca(spark, d):
    a = taxonomy.lca(taxa_hit(spark, d), "doc_id", "l", 3)
    return a.select("doc_id", F.col("level").cast("long").alias("level"), F.col("taxon").cast("long").alias("taxon"))


def tree_edges(spark, d):
    """(level, parent, child): regions, nations, customers."""
    n, r, c = (table(spark, d, x) for x in ("nation", "region", "customer"))
    upper = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit(0).cast("long").alias("level"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    lower = c.join(n, c.c_nationkey == n.n_nationkey).select(F.lit(1).cast("long").alias("level"), F.col("n_name").alias("parent"), F.col("c_name").alias("child"))
    return upper.union(lower).distinct()


def tax_edges(spark, d):
    return tree_edges(spark, d)


def leaf_counts(spark, d):
    return taxonomy.leaf_counts(tree_edges(spark, d))


def postorder(spark, d):
    """The tree of all levels: customers, nations, regions and their root."""
    e = tree_edges(spark, d).select("parent", "child")
    return taxonomy.postorder(e.union(table(spark, d, "region").select(F.lit("ALL").alias("parent"), F.col("r_name").alias("child"))))


def _customers(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    count = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(count, n.n_nationkey == count.c_nationkey, "left").select(F.col("n_regionkey").cast("long").alias("n_regionkey"), F.col("n_nationkey").cast("long").alias("n_nationkey"), F.coalesce("n", F.lit(0)).alias("n"))


def heavy_child(spark, d):
    return taxonomy.heavy_children(_customers(spark, d), "n_regionkey", "n_nationkey", "n")


def sibling_order(spark, d):
    return taxonomy.sibling_order(_customers(spark, d), "n_regionkey", "n_nationkey", "n")


def heavy_path(spark, d):
    return taxonomy.heavy_paths(tree_edges(spark, d).select("parent", "child"))


def match_level(spark, d):
    t = kmer.top(best_scores(spark, d), "doc_id", "item_id", 2).withColumn("tid", F.col("item_id") % 25).join(lineage(spark, d), "tid")
    one = lambda r: F.max(F.when(F.col("rank") == r, F.col("l")))
    p = t.groupBy("doc_id").agg(one(1).alias("a"), one(2).alias("b")).where("b is not null")
    return p.select("doc_id", taxonomy.match_level(F.col("a"), F.col("b"), 3).cast("long").alias("level"))


def lineage_rollup(spark, d):
    n, r, c = (table(spark, d, x) for x in ("nation", "region", "customer"))
    counts = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    full = counts.join(n, counts.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.array("r_name", "n_name").alias("lineage"), "n")
    return taxonomy.lineage_rollup(full, "lineage", "n")


# Clusters


def cluster_length_coverage(spark, d):
    o, c, li = (table(spark, d, x) for x in ("orders", "customer", "lineitem"))
    by_order = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(by_order, o.o_orderkey == by_order.l_orderkey)
    return j.groupBy("c_mktsegment").agg(F.round(F.sum("q"), 2).alias("length"), F.round(F.try_divide(F.sum("p"), F.sum("q")), 6).alias("coverage"))


def _score_union(spark, d):
    a = best_scores(spark, d).select("doc_id", "item_id", F.col("score").cast("double").alias("score"))
    b = whole_scores(spark, d)
    u = a.unionByName(b).select("doc_id", (F.col("item_id") % 25).alias("tid"), "score").where("tid > 0")
    return u.groupBy("doc_id", "tid").agg(F.round(F.sum("score"), 6).alias("score"))


def species_score_union(spark, d):
    return _score_union(spark, d)


def best_species(spark, d):
    return kmer.best(_score_union(spark, d), "doc_id", "tid")


def best_target_by_lineage(spark, d):
    sp = kmer.best(_score_union(spark, d), "doc_id", "tid").select("doc_id", "tid").join(lineage(spark, d).withColumnRenamed("l", "want"), "tid").drop("tid")
    s = best_scores(spark, d).withColumn("tid", F.col("item_id") % 25).join(lineage(spark, d), "tid").join(sp, "doc_id")
    s = s.withColumn("level", taxonomy.match_level(F.col("l"), F.col("want"), 7))
    m = s.groupBy("doc_id").agg(F.min(F.struct("level", (-F.col("score")).alias("s"), "item_id")).alias("m"))
    return m.select("doc_id", F.col("m.level").cast("long").alias("level"), F.col("m.item_id").alias("item_id"), (-F.col("m.s")).alias("score"))


def _by_source(spark, d, how):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return best_scores(spark, d).join(docs, "doc_id").groupBy("source", "item_id").agg(how(F.col("score")).alias("score"))


def cluster_topk_sum(spark, d):
    return kmer.top(_by_source(spark, d, F.sum), "source", "item_id", 10)


def cluster_topk_max(spark, d):
    return kmer.top(_by_source(spark, d, F.max), "source", "item_id", 10)


def _cluster_report(spark, d, how):
    """Targets of each source by score, as many as the reference reports, with the number of all candidates."""
    every = _by_source(spark, d, how).withColumn("candidates", F.count(F.lit(1)).over(W.partitionBy("source")))
    return kmer.top(every, "source", "item_id", P.cluster_targets)


def cluster_report_sum(spark, d):
    return _cluster_report(spark, d, F.sum)


def cluster_report_max(spark, d):
    return _cluster_report(spark, d, F.max)


def topk_relative_cut(spark, d):
    t = kmer.top(_by_source(spark, d, F.sum), "source", "item_id", 20)
    return t.withColumn("best", F.max("score").over(W.partitionBy("source"))).where("score * 20 >= best").drop("best")


def virtual_contigs(spark, d):
    t = targets(spark, d).withColumn("genome", F.floor(F.col("item_id") / 4).cast("long"))
    return report.virtual_contigs(t, "genome", "item_id")


# Statistics


def entropy_majority(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return stats.entropy_majority(n, ["o_custkey"], "v").withColumn("entropy", F.round("entropy", 6))


def level_by_entropy(spark, d):
    o = table(spark, d, "orders")
    values = F.array(F.col("o_orderpriority"), F.col("o_orderstatus"), F.year("o_orderdate").cast("string"))
    e = o.select("o_custkey", F.posexplode(values).alias("level", "v")).groupBy("o_custkey", "level", "v").agg(F.count(F.lit(1)).alias("n"))
    t = stats.entropy_majority(e, ["o_custkey", "level"], "v").withColumn("entropy", F.round("entropy", 6))
    return stats.level_by_entropy(t, "o_custkey", "level", 0.5).withColumn("level", F.col("level").cast("long"))


def _flags(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return stats.composition(n, "l_suppkey")


def score_max_share(spark, d):
    return _flags(spark, d).select("l_suppkey", F.round("max_share", 6).alias("max_share"))


def score_top2_gap(spark, d):
    return _flags(spark, d).select("l_suppkey", F.round("top2_gap", 6).alias("top2_gap"))


def composition_log2(spark, d):
    return _flags(spark, d).select("l_suppkey", F.round("log2_sum", 6).alias("log2_sum"))


def confusion_cube(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy(F.col("quality").cast("long").alias("ref"), F.col("toxic").cast("long").alias("pred"), "lang").agg(F.count(F.lit(1)).alias("n"))


def _levels(spark, d):
    at = lambda x: F.least(F.floor(x), F.lit(7)).cast("long")
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("ref"), at(F.col("l_quantity") / 7).alias("pred"), at(F.col("l_discount") * 100).alias("correct"))
    return li.groupBy("ref", "pred", "correct").agg(F.count(F.lit(1)).alias("n"))


def confusion_summary(spark, d):
    return stats.confusion_summary(_levels(spark, d))


def gaussian_confidence(spark, d):
    e = table(spark, d, "events")
    levels = e.groupBy(F.col("event_type").alias("level")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("weight"))
    v = e.groupBy("user_id").agg(F.avg("value").alias("v"))
    g = stats.gaussian_confidence(v, "user_id", "v", levels)
    return g.select("user_id", F.col("level").alias("event_type"), F.round("confidence", 6).alias("confidence"))


def confusion_matrix(spark, d):
    return stats.confusion_matrix(_levels(spark, d), 8)


def pair_stats(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.col("event_id") % 2).alias("m"), "event_type", "value")
    one = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    p = e.groupBy("pair").agg(one(0, "event_type").alias("t0"), one(1, "event_type").alias("t1"), one(0, "value").alias("v0"), one(1, "value").alias("v1"))
    p = p.where("t0 is not null and t1 is not null")
    return p.groupBy((F.col("t0") == F.col("t1")).cast("long").alias("same_type"), F.floor(F.abs(F.col("v0") - F.col("v1")) / 10).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cluster_accuracy(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return stats.cluster_accuracy(n, "source", "lang").select(F.round("precision", 6).alias("precision"), F.round("sensitivity", 6).alias("sensitivity"))


def purity(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return stats.purity(n, "source", "lang").withColumn("purity", F.round("purity", 6))


def level_statistics(spark, d):
    """Mean and spread of l_extendedprice by the level that supplier and customer nations share (0 nation, 1 region, 2 root)."""
    li, o, c, s = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "supplier"))
    lin = lineage(spark, d)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    j = j.join(lin.select(F.col("tid").alias("c_nationkey"), F.col("l").alias("a")), "c_nationkey").join(lin.select(F.col("tid").alias("s_nationkey"), F.col("l").alias("b")), "s_nationkey")
    t = stats.level_statistics(j.withColumn("level", taxonomy.match_level(F.col("a"), F.col("b"), 3)), "level", "l_extendedprice")
    return t.select(F.col("level").cast("long").alias("level"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


# Graphs and intervals


def _mates(spark, d):
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.col("event_id") % 2).alias("mate"), "user_id")


def pe_edges(spark, d):
    return graph.pair_edges(_mates(spark, d), "pair", "mate", "user_id")


def pe_node_weights(spark, d):
    return graph.node_weights(pe_edges(spark, d))


def components(spark, d):
    return graph.components(pe_edges(spark, d).where("w >= 3"))


def pe_merge(spark, d):
    length = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("length"))
    return graph.merge_steps(_mates(spark, d), "pair", "mate", "user_id", length, ((0.04, False), (0.03, True), (0.025, True)), 140)


def pe_merge_ordered(spark, d):
    """As pe_merge, with the edges of a pass taken one after another."""
    length = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("length"))
    return graph.merge_in_order(pe_edges(spark, d), length, ((0.04, False), (0.03, True), (0.025, True)), 140)


def interval_merge(spark, d):
    start = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    e = table(spark, d, "events").select("user_id", start.alias("a")).withColumn("b", F.col("a") + 3_600_000_000)
    return graph.islands(e, "user_id", "a", "b")


def overlap_mismatch(spark, d):
    c = contigs(spark, d)
    nxt = c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    o = c.join(nxt, "doc_id").select("doc_id", S.overlap(F.col("s"), F.col("t"), (F.col("doc_id") % 5).cast("int")).alias("o"))
    return o.select("doc_id", F.col("o.match").cast("long").alias("n_match"), F.col("o.mismatch").cast("long").alias("n_mismatch"))


def read_overlaps(spark, d):
    """Targets that share an 8-mer and overlap in at least 8 bases with at most one mismatch, merged into components."""
    t = targets(spark, d).select(F.col("item_id").alias("id"), "s")
    return graph.components(mapping.overlap_edges(t, 8, (F.col("match") >= 8) & (F.col("mismatch") <= 1)))


# Text indexes


def suffix_array(spark, d):
    return suffixes.suffix_order(targets(spark, d), "item_id")


def bwt(spark, d):
    return suffixes.bwt(targets(spark, d), "item_id")


def region_lookup_asof(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("q"))
    regions = li.withColumn("end", F.sum("q").over(W.partitionBy("l_orderkey").orderBy("line")))
    probes = li.groupBy("l_orderkey").agg(F.sum("q").alias("total")).select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"), F.lit(10).cast("long"))).alias("pos"))
    return graph.region_of(probes, regions, "l_orderkey", "pos", "end", "line")


def common_kmers_all(spark, d):
    t = targets(spark, d).withColumn("genome", F.floor(F.col("item_id") / 4).cast("long"))
    return textindex.common_kmers(t, "genome", "item_id", 4)


def common_substrings(spark, d):
    t = targets(spark, d).withColumn("genome", F.floor(F.col("item_id") / 4).cast("long"))
    return suffixes.set_substrings(t, "genome", "item_id", 3)


def set_substrings(spark, d):
    """In every target, the places of the longest substrings that all targets of its genome hold."""
    t = targets(spark, d).withColumn("genome", F.floor(F.col("item_id") / 4).cast("long"))
    return suffixes.set_substrings(t, "genome", "item_id", 3, everywhere=True)


def lcp_depth_clean(spark, d):
    return suffixes.lcp_depth(targets(spark, d), "item_id")


def lcp_depth_summary(spark, d):
    return lcp_depth_clean(spark, d).groupBy("item_id").agg(F.round(F.avg("depth"), 6).alias("mean_depth"), F.count(F.lit(1)).alias("n"))


def read_classify(spark, d):
    c = contigs(spark, d)
    return textindex.classify_reads(c, c, 12, 12, 5, "doc_id")


def read_classify_extended(spark, d):
    """Benchmark items as reads on the documents; of the 12 characters before a k-mer those count that the documents have there."""
    c = contigs(spark, d).select(F.col("doc_id").alias("id"), "s")
    return textindex.classify_extended(targets(spark, d).select(F.col("item_id").alias("id"), "s"), c, 8, 12, 2, "id").withColumnRenamed("id", "item_id")


# Reports


def species_gene_report(spark, d):
    p = table(spark, d, "part").where("p_size >= 10")
    return report.gene_report(p, "p_brand", "p_type", 10, 10)


def read_contig_map(spark, d):
    best = kmer.best(annotate_contigs(spark, d), "doc_id", "item_id")
    return table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"))


def annotation_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return read_contig_map(spark, d).join(docs, "doc_id").groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("n"))


def unassigned_bucket(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(annotate_contigs(spark, d), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def multi_key_sort(spark, d):
    """Every line with its rank by flag, status, and quantity downwards."""
    keys = [F.asc("l_returnflag"), F.asc("l_linestatus"), F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    t = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return report.ranked(t, keys)


def score_lines(spark, d):
    """The score file's second lines: `item score ...` per document, empty without a hit."""
    s = annotate_contigs(spark, d).select(F.col("doc_id").alias("ctg_id"), F.col("item_id").alias("sid"), "score")
    return report.score_lines(s, contigs(spark, d).select(F.col("doc_id").alias("ctg_id")), P.hit_threshold)


def cluster_members(spark, d):
    """Customers as reads by segment, titled by name where their balance is positive."""
    c = table(spark, d, "customer")
    return report.cluster_members(c.select(F.col("c_mktsegment").alias("cluster"), F.col("c_custkey").alias("read_id")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("read_id"), F.col("c_name").alias("title")))


# Mapping and descent


def read_mapping(spark, d):
    """Benchmark items as reads on the documents: best place by equal bases, at least 95 % of the read."""
    reads = targets(spark, d).select(F.col("item_id").alias("read_id"), "s")
    return mapping.map_reads(reads, contigs(spark, d).select(F.col("doc_id").alias("ctg_id"), "s"), P.k, F.col("score") >= 0.95 * F.col("size"))


def near_best_lca(spark, d):
    """The lowest common ancestor of the targets within a tenth of a document's best score."""
    near = mapping.near_best(best_scores(spark, d), "doc_id", 0.9).withColumn("tid", F.col("item_id") % 25).join(lineage(spark, d), "tid")
    a = taxonomy.lca(near, "doc_id", "l", 3)
    return a.select("doc_id", F.col("level").cast("long").alias("level"), F.col("taxon").cast("long").alias("taxon"))


def threshold_level(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return s.select("l_suppkey", "score", mapping.risen_level(F.col("score"), [0.055, 0.052, 0.05, 0.045]).cast("long").alias("level"))


def _nation_matrix(spark, d):
    """Mean prices of what suppliers of a nation sell to customers of another, as similarities of nations, a matrix for each way of return."""
    li, o, c, s = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.groupBy(F.col("l_returnflag").alias("k"), F.col("s_nationkey").cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("j")).agg(F.avg("l_extendedprice").alias("value"))


def learned_levels(spark, d):
    t = thresholds.learned(_nation_matrix(spark, d), lineage(spark, d).withColumnRenamed("tid", "genome"), 3)
    return t.select("k", "genome", F.col("level").cast("long").alias("level"), "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def level_descent(spark, d):
    """Suppliers' mean prices, descended along the levels learned for their nation."""
    bounds = thresholds.boundaries(thresholds.learned(_nation_matrix(spark, d), lineage(spark, d).withColumnRenamed("tid", "genome"), 3), 3)
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    mine = li.groupBy(F.col("l_returnflag").alias("k"), "l_suppkey").agg(F.round(F.avg("l_extendedprice"), 2).alias("score"))
    c = mine.join(s, mine.l_suppkey == s.s_suppkey).select("k", "l_suppkey", F.col("s_nationkey").cast("long").alias("genome"), "score", F.lit(0).alias("level"))
    return thresholds.descended(c, bounds, 3).drop("level")


def rank_lineages(spark, d):
    """Lineages from a parent table: species (customer), genus (nation), family (region), root."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    node = lambda t, tid, parent, rank: t.select(tid.cast("long").alias("tid"), parent.cast("long").alias("parent"), F.lit(rank).alias("rank"))
    nodes = node(c, F.col("c_custkey") + 10000, F.col("c_nationkey") + 1000, "species").union(node(n, F.col("n_nationkey") + 1000, F.col("n_regionkey") + 100, "genus"))
    nodes = nodes.union(node(r, F.col("r_regionkey") + 100, F.lit(1), "family")).union(node(r, F.lit(1), F.lit(1), "root").distinct())
    ranks = ["species", "genus", "family", "root"]
    return taxonomy.rank_table(nodes, ranks).select("tid", *(F.col("l")[k].alias(name) for k, name in enumerate(ranks)))


def cluster_species_scores(spark, d):
    """Per source, the sum over documents of the best score of each taxon, without the taxa of one family."""
    by_doc = best_scores(spark, d).groupBy("doc_id", (F.col("item_id") % 25).alias("tid")).agg(F.max("score").alias("score"))
    kept = by_doc.join(lineage(spark, d), "tid").where(F.col("l")[1] != 3)
    return kept.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "tid").agg(F.sum("score").alias("score"))


def cluster_best(spark, d):
    """The best target of every source by sum, with its taxon; (-1, 0) without a hit."""
    won = kmer.best(_by_source(spark, d, F.sum), "source", "item_id")
    every = table(spark, d, "documents").select("source").distinct()
    j = every.join(won, "source", "left")
    return j.select("source", F.coalesce("item_id", F.lit(-1)).alias("item_id"), F.coalesce(F.col("item_id") % 25, F.lit(0)).alias("tid"), F.coalesce("score", F.lit(0)).alias("score"))


def node_kmers(spark, d):
    """4-mers that all targets below a region or nation hold; a target hangs below the nation of its number mod 25."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t = targets(spark, d)
    upper = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    leaf = t.withColumn("tid", F.col("item_id") % 25).join(n, F.col("tid") == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("item_id").cast("string").alias("child"))
    return taxonomy.node_kmers(upper.union(leaf), t.select(F.col("item_id").cast("string").alias("node"), "s"), 4)


def ignored_targets(spark, d):
    """Hits left when the targets of nations of the first region are on the ignore list."""
    ignore = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("tid"))
    return annotate_contigs(spark, d).withColumn("tid", F.col("item_id") % 25).join(ignore, "tid", "left_anti").select("doc_id", "item_id", "score")


# Composition clusters


def qmer_profile(spark, d):
    return cluster.qmer_profile(contigs(spark, d), P.qmer, "doc_id")


def kmeans_clusters(spark, d):
    return cluster.kmeans(table(spark, d, "embeddings"), 10, "embedding").select("vec_id", "cluster")


def qmer_clusters(spark, d):
    """Documents clustered by their q-mer shares, the best of ten runs."""
    v = written(cluster.qmer_vectors(contigs(spark, d), P.qmer, "doc_id"))
    return cluster.kmeans(v, 10, "profile", restarts=P.restarts).select("doc_id", "cluster")


def qmer_spearman(spark, d):
    """Documents clustered by the ranks of their q-mer shares, and clusters merged at the correlation of 0.97."""
    v = cluster.qmer_vectors(contigs(spark, d), P.qmer, "doc_id")
    return cluster.spearman_clusters(v, "doc_id", "profile", 10, P.merge_threshold, restarts=2)


def iter_merge(spark, d):
    return cluster.iterative_merge(table(spark, d, "embeddings"), "embedding", 20, 0.5).select("vec_id", "cluster")


# Genomes and their index


def _genomes(spark, d):
    return targets(spark, d).select(F.col("item_id").alias("seqid"), "s")


def _seq_tax(spark, d):
    """Suppliers as the table of taxa: sequences without a supplier of their number have none."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("seqid"), F.col("s_nationkey").cast("long").alias("taxid"))


def _regions(spark, d):
    """Order lines as regions, from three bases before the line's number times nine, as long as the quantity."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seqid"), (F.col("l_linenumber").cast("long") * 9 - 12).alias("start"), F.col("l_quantity").cast("long").alias("q"))
    return li.select("seqid", "start", (F.col("start") + F.col("q")).alias("end")).distinct()


def genome_taxa(spark, d):
    return genomes.with_taxon(_genomes(spark, d), _seq_tax(spark, d)).select("seqid", "taxid", F.length("s").cast("long").alias("size"))


def region_genes(spark, d):
    return genomes.genes(_genomes(spark, d), _regions(spark, d)).select("seqid", "start", "end", "gene")


def genome_text(spark, d):
    return genomes.joined_genes(genomes.genes(_genomes(spark, d), _regions(spark, d)))


def genome_index(spark, d):
    return genomes.genome_index(_genomes(spark, d), _seq_tax(spark, d), _regions(spark, d), 8)


def edge_strings(spark, d):
    return genomes.edge_strings(targets(spark, d), "item_id", P.k, 8)


def locate_counts(spark, d):
    return genomes.locate_counts(targets(spark, d), contigs(spark, d), 8, "item_id")


# Both strands, and contigs with reads


def _reads(spark, d):
    return targets(spark, d).select(F.col("item_id").alias("read_id"), "s")


def read_mapping_strands(spark, d):
    """read_mapping with the reverse complements of the odd items' sequences as reads, so that half of them lie on the other strand."""
    s = F.when(F.col("read_id") % 2 == 1, S.reverse_complement(F.col("s"))).otherwise(F.col("s"))
    reads = _reads(spark, d).select("read_id", s.alias("s"))
    m = mapping.map_both_strands(reads, contigs(spark, d).select(F.col("doc_id").alias("ctg_id"), "s"), P.k, F.col("score") >= 0.95 * F.col("size"))
    return m.withColumn("strand", F.col("strand").cast("long"))


def _contig_read_edges(spark, d):
    scored = written(read_mapping_strands(spark, d).where("score >= 15").select("read_id"))  # reads that map too badly link nothing
    reads = _reads(spark, d).join(scored, "read_id", "left_semi")
    return mapping.contig_read_edges(contigs(spark, d).select(F.col("doc_id").alias("ctg_id"), "s"), reads, P.k, 14)


def contig_read_edges(spark, d):
    return _contig_read_edges(spark, d)


def contig_read_merge(spark, d):
    """Components of contigs (node doc_id) and reads (node -1 - item_id) that overlap."""
    e = _contig_read_edges(spark, d).select(F.col("ctg_id").alias("u"), (-1 - F.col("read_id")).alias("v"))
    return graph.components(e)


def component_sizes(spark, d):
    return components(spark, d).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


# Whole results, with the rules for owners without any


def genome_hit_lines(spark, d):
    """Per document, `genome hits ...` of the genomes of all targets that its fragments hit; empty without a hit."""
    g = best_scores(spark, d).groupBy(F.col("doc_id").alias("ctg_id"), F.floor(F.col("item_id") / 4).cast("long").alias("sid")).agg(F.sum("score").alias("score"))
    return report.score_lines(g, contigs(spark, d).select(F.col("doc_id").alias("ctg_id")), 1)


def best_species_by_set(spark, d):
    """Per source, the taxon with the largest sum of best fragment hits and the one with the largest sum of shares of whole texts; 0 without one."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    tid = (F.col("item_id") % 25).alias("tid")
    hits = best_scores(spark, d).select("doc_id", tid, F.col("score").cast("double").alias("score"), F.lit("hits").alias("set"))
    shares = whole_scores(spark, d).select("doc_id", tid, "score", F.lit("shares").alias("set"))
    s = hits.union(shares).join(docs, "doc_id").groupBy("source", "set", "tid").agg(F.round(F.sum("score"), 6).alias("score"))
    one = lambda name: F.coalesce(F.max(F.when(F.col("set") == name, F.struct("score", (-F.col("tid")).alias("t"))))["t"] * -1, F.lit(0)).alias(f"by_{name}")
    every = docs.select("source").distinct().select("source", F.lit(None).cast("string").alias("set"), F.lit(None).cast("long").alias("tid"), F.lit(None).cast("double").alias("score"))
    return s.union(every).groupBy("source").agg(one("hits"), one("shares"))


def cluster_k_scores(spark, d):
    """Per source, k and target, the sum of the documents' hits, and their maximum over every k."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    n = kmer.unit_hits(multi_hits(spark, d), "doc_id", "item_id", "k")
    s = n.join(docs, "doc_id").groupBy("source", "item_id", "k").agg(F.sum("n").alias("total"), F.max("n").alias("best"))
    return s.withColumn("best", F.max("best").over(W.partitionBy("source", "item_id")))


def cluster_best_fixed(spark, d):
    """The best target of every source by sum, unless one of its documents hits a target 20 times or more: then the best by that."""
    fixed = kmer.best(_by_source(spark, d, F.max).where("score >= 20"), "source", "item_id")
    return kmer.best_or_fixed(_by_source(spark, d, F.sum), fixed, "source", "item_id")


def best_species_all(spark, d):
    """The best taxon of every document, 0 without one."""
    best = best_species(spark, d)
    return table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("tid", F.lit(0)).alias("tid"), F.coalesce("score", F.lit(0.0)).alias("score"))


def genome_vote_counts(spark, d):
    """Per document, the genomes among its ten best targets and how many different ones there are."""
    t = kmer.top(best_scores(spark, d), "doc_id", "item_id", 10)
    return t.groupBy("doc_id").agg(F.count_distinct(F.floor(F.col("item_id") / 4)).alias("genomes"), F.count(F.lit(1)).alias("targets"))


def composition_log2_all(spark, d):
    """As composition_log2 of all customers by their orders' priorities; 1e9 without an order."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return stats.log2_sums(table(spark, d, "customer"), n, "c_custkey").withColumn("log2_sum", F.round("log2_sum", 6))


def confusion_variants(spark, d):
    """Levels of lines by quantity (the line itself) and by discount (its neighbour), with quantities as reads."""
    at = lambda x: F.least(F.floor(x), F.lit(7)).cast("long")
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("ref"), F.col("l_quantity").cast("long").alias("w"), at(F.col("l_quantity") / 7).alias("p"), at(F.col("l_discount") * 100).alias("q"), at(F.col("l_tax") * 100).alias("c"))
    return stats.confusion_variants(li, "ref", "w", {"own": ("p", "c"), "nearest": ("q", "c")})


def confusion_nearest(spark, d):
    """Levels of lines by quantity and tax, apart for those whose discount level is at most the line's number."""
    at = lambda x: F.least(F.floor(x), F.lit(7)).cast("long")
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("ref"), F.col("l_quantity").cast("long").alias("w"), at(F.col("l_quantity") / 7).alias("p"), at(F.col("l_discount") * 100).alias("q"), at(F.col("l_tax") * 100).alias("c"))
    split = stats.nearest_split(li, "ref", "p", "c", "q", "w")
    share = stats.unassigned_ratio(split, 7).withColumn("unassigned", F.round("unassigned", 6))
    return split.join(share, ["nearest_right", "ref"])


def best_target_all(spark, d):
    """best_target_by_lineage of every document; target 0 at level 7 without one."""
    best = best_target_by_lineage(spark, d)
    return table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("level", F.lit(7)).cast("long").alias("level"), F.coalesce("item_id", F.lit(0)).alias("item_id"), F.coalesce("score", F.lit(0)).alias("score"))


def gene_species(spark, d):
    """Targets by the language of the documents that they hit with a score of 7 or more, as genes by the species that contigs are labelled by."""
    hits = annotate_contigs(spark, d).select(F.col("doc_id").alias("contig"), F.col("item_id").alias("gene"), F.col("score").alias("identity"))
    labels = table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("contig"), F.col("lang").alias("species"))
    return report.labelled_hits(hits, labels, 7).groupBy("species", "gene").agg(F.count(F.lit(1)).alias("contigs"))


def pair_mapping(spark, d):
    """Pairs of events as mates: events of value 50 or more map to their user mod 10."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.col("event_id") % 2).alias("mate"), F.when(F.col("value") >= 50, F.col("user_id") % 10).alias("target"), F.floor("value").cast("long").alias("score"))
    return mapping.pair_mapping(e, "pair", "mate", "target", "score").withColumn("score", F.coalesce("score", F.lit(-1)).cast("long"))


def read_group_merge(spark, d):
    """Components of documents that the reads of a group lie on; a group is an even item and the next one."""
    groups = table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("type"), (F.col("item_id") + 1).alias("newtype"))
    return graph.components(mapping.group_links(groups, read_mapping(spark, d)))


def read_merge(spark, d):
    """Components of documents that overlapping reads lie on; overlaps hold 8 equal bases or more and reach the binomial bound."""
    reads = targets(spark, d).select(F.col("item_id").alias("id"), "s")
    pairs = mapping.overlap_edges(reads, 8, mapping.good_overlap(F.col("match"), F.col("mismatch"), 8))
    return graph.components(mapping.read_links(read_mapping(spark, d), pairs))


def leaf_parents(spark, d):
    return taxonomy.leaf_parents(tree_edges(spark, d))


def length_extremes(spark, d):
    """Per language, the number of sequences, the longest and the shortest."""
    c = table(spark, d, "documents").select("lang", F.length(S.dna(F.col("text"))).cast("long").alias("n"))
    return c.groupBy("lang").agg(F.count("n").alias("sequences"), F.max("n").alias("longest"), F.min("n").alias("shortest"))


def cluster_annotation(spark, d):
    """Per source: the level and name of the taxon that its best target belongs to (its region where two best targets of different nations tie), and the mean coverage."""
    s = _by_source(spark, d, F.sum).withColumn("best", F.max("score").over(W.partitionBy("source"))).where("score = best")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("tid"), "n_name", "r_name")
    t = s.withColumn("tid", F.col("item_id") % 25).join(named, "tid").groupBy("source").agg(F.min("n_name").alias("n1"), F.max("n_name").alias("n2"), F.min("r_name").alias("r1"), F.max("r_name").alias("r2"))
    docs = table(spark, d, "documents").select("source", F.length("text").alias("size"), F.length(S.dna(F.col("text"))).alias("bases"))
    cover = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.try_divide(F.col("bases"), F.col("size"))), 6).alias("coverage"))
    level = F.when(F.col("n1") == F.col("n2"), "nation").when(F.col("r1") == F.col("r2"), "region").when(F.col("n1").isNotNull(), "root").otherwise("none")
    taxon = F.when(F.col("n1") == F.col("n2"), F.col("n1")).when(F.col("r1") == F.col("r2"), F.col("r1"))
    return cover.join(t, cover.source.eqNullSafe(t.source), "left").select(cover.source, level.alias("level"), F.coalesce(taxon, F.lit("")).alias("taxon"), "n", "coverage")


# Files written and read back


def fasta_file(spark, d):
    """Benchmark items as FASTA records of 60 bases a line whose headers hold `>`, written and read back."""
    t = table(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(" >"), F.regexp_replace("text", r"[^A-Za-z]", ">")).alias("header"), S.dna(F.col("text")).alias("s"))
    with Scratch(spark) as space:
        sinks.fasta_file(t, space.path, "header", "s", 60)
        return written(readers.fasta(spark, space.path).select(F.col("seq_id").cast("long").alias("item_id"), "header", F.col("seq").alias("s")))


def region_file(spark, d):
    """Order lines as regions of sequences with numbers for ids, written and read back."""
    with Scratch(spark) as space:
        sinks.region_file(_regions(spark, d), space.path)
        return written(readers.regions(spark, space.path).select(F.col("seqid").cast("long").alias("seqid"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start >= 0"))

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from taxaloom.operators import kmer
from taxaloom.params import Params
from taxaloom.sources import readers, sinks
from taxaloom.streaming import contigs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        return str(p)

    return put


def test_fasta(spark, folder):
    p = folder("a.fa", ">one x\nACGT\nAC\n>two\nGG\n")
    assert rows(readers.fasta(spark, p).select("seq_id", "header", "seq")) == [("one", "one x", "ACGTAC"), ("two", "two", "GG")]
    assert rows(readers.fasta(spark, p, 3).select("seq_id")) == [("one",)]
    assert readers.first_read_length(spark, p) == 6
    assert rows(readers.single_fasta(spark, folder("g.fna", ">g d\nAC\nGT")).select("header", "seq")) == [("g d", "ACGT")]


def test_folder(spark, folder, tmp_path):
    folder("d/x/a.fna", ">a\nAC\n")
    folder("d/b.fna", ">b\nGT\n")
    folder("d/c.txt", ">c\nGT\n")
    assert rows(readers.fasta_folder(spark, str(tmp_path / "d")).select("seq_id", "seq")) == [("a", "AC"), ("b", "GT")]


def test_tables(spark, folder):
    t = readers.seq_tax(spark, folder("t", "f a 7 30\nf b 2 20\n\nf a 1 10\n"))
    assert rows(t) == [("a", 1, 10), ("b", 2, 20)] and readers.longest(t) == 20 and readers.longest(t.limit(0)) == 0
    assert rows(readers.regions(spark, folder("r", "s1 2\n1 10 3 5\ns2 1 7 9\n"))) == [("s1", 1, 10), ("s1", 3, 5), ("s2", 7, 9)]
    r = spark.createDataFrame([("s", 1, 10), ("s", 3, 3), ("s", 0, 5), ("s", 5, 11)], "seqid string, start int, end int")
    n = spark.createDataFrame([("s", 10)], "seqid string, len int")
    assert rows(readers.valid_regions(r, n).select("start", "end")) == [(1, 10)]
    assert rows(readers.matrix(spark, folder("m", "1 2\n3 4\n"), 2)) == [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 0, 3.0), (0, 1, 1, 4.0)]
    assert rows(readers.taxonomy_nodes(spark, folder("n", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n"))) == [(1, 1, "no rank"), (2, 1, "genus")]
    assert rows(readers.edges(spark, folder("e", "1 2\n3 4\n"))) == [(1, 2), (3, 4)]
    assert rows(readers.index_info(spark, folder("i", "g1\t5\t100\tp\ng2\t6\t50\tq\n")).select("genome_idx", "taxid")) == [(0, 5), (1, 6)]
    assert rows(readers.frequent_kmers(spark, folder("f", "ACGT 3\nGGCC 7\n"))) == [("ACGT", 3), ("GGCC", 7)]
    assert rows(readers.lcp_intervals(spark, folder("d", "3 1 2 5 9\n"))) == [(3, 1, 2, 5, 9)]
    assert rows(readers.lengths(spark, folder("g", "g1 12\n"))) == [("g1", 12)]
    assert rows(readers.species_labels(spark, folder("q", "c 1\ta sp\n"))) == [("c 1", "a sp")]
    assert rows(readers.count_report(spark, folder("k", "5\tBacteria\t x\n\n3\tArchaea\n"))) == [(3, ["Archaea"]), (5, ["Bacteria", "x"])]
    assert rows(readers.gene_hits(spark, folder("h", "c_1_7\tg\t80\n")).select("contig", "gene", "identity")) == [("c_1", "g", 80.0)]
    c = readers.catalogue(spark, folder("c", "st\tid1\tBacteria;p;p\t1\tsp\td\nst\tid2\tArchaea;q\t1\tsp\td\n"))
    assert rows(readers.catalogue_edges(c)) == [(0, "Bacteria", "p1"), (1, "p1", "p2"), (2, "p2", "id1")]
    assert readers.optional_index(spark, "/nowhere/at/all", "kmer string").count() == 0
    with pytest.raises(AnalysisException):
        readers.optional_index(spark, folder("w", "x"), "kmer string, kmer int").count()
    assert rows(readers.read_groups(spark, folder("u", "1 2 3\n"))) == [(1, 2, 3)]
    assert rows(readers.bins(spark, folder("v", "4 5\n"))) == [(4, 5)]


def test_two_line_fasta(spark, folder):
    p = folder("two", ">a x\nACGT\n>b\nGG\n\n>c\nTT\n")
    assert rows(readers.two_line_fasta(spark, p)) == [(0, "a x", "ACGT"), (1, "b", "GG")]
    assert rows(readers.titles(spark, p, 1)) == [(0, "a x")] and rows(readers.titles(spark, p, 9)) == [(0, "a x"), (1, "b")]


def test_regions_over_splits(spark, folder):
    """Records that span lines, blocks and files are those of one pass over the tokens."""
    want, text = [], ""
    for k in range(60):
        pairs = [(k + 10 * i, k + 10 * i + 5) for i in range(k % 7)]
        want += [(f"s{k}", a, b) for a, b in pairs]
        text += f"s{k} {len(pairs)}" + "".join(f"{'\n' if (k + i) % 3 else ' '}{a} {b}" for i, (a, b) in enumerate(pairs)) + "\n"
    folder("reg/a", text)
    p = folder("reg/b", "x 1\n1 2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        assert rows(readers.regions(spark, p.rsplit("/", 1)[0])) == sorted([*want, ("x", 1, 2)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_with_marks(spark, folder):
    p = folder("a.fa", "no record\n>s1 A>G variant\r\nACGT\r\n>s2 >x > y\nAC\n GT>\n\n>s3\n>s4\nA\n")
    want = [("s1", "s1 A>G variant", "ACGT"), ("s2", "s2 >x > y", "ACGT>"), ("s3", "s3", ""), ("s4", "s4", "A")]
    assert rows(readers.fasta(spark, p).select("seq_id", "header", "seq")) == want
    assert readers.first_read_length(spark, p) == 4
    assert readers.first_read_length(spark, folder("e.fa", "")) == 0 and readers.fasta(spark, folder("f.fa", "x\n")).count() == 0
    folder("d/a.fna", ">s1 A>G\nAC\nGT\n")
    assert rows(readers.fasta_folder(spark, p.replace("a.fa", "d")).select("seq_id", "seq")) == [("s1", "ACGT")]


def test_records_over_splits(spark, folder, small_blocks):
    want, text = [], ""
    for k in range(40):
        lines = [("ACGT" * 9)[: (7 * k + i) % 33] for i in range(k % 9)]
        want.append((f"r{k}", f"r{k} of > {k}", "".join(lines)))
        text += f">r{k} of > {k}\n" + "".join(x + "\n" for x in lines)
    p = folder("many/a.fa", text)
    folder("many/b.fa", ">z\nAAA")
    assert spark.read.text(p).rdd.getNumPartitions() > 20
    assert rows(readers.fasta(spark, p).select("seq_id", "header", "seq")) == sorted(want)
    assert rows(readers.fasta(spark, p.rsplit("/", 1)[0]).select("seq_id", "header", "seq")) == sorted([*want, ("z", "z", "AAA")])
    assert readers.first_read_length(spark, p) == len(want[0][2])


def test_numeric_region_ids(spark, folder, small_blocks):
    assert rows(readers.regions(spark, folder("n/r", "12345 2\n1 10 3 5\n2 1 7 9\n5 0\n8 1 4"))) == [("12345", 1, 10), ("12345", 3, 5), ("2", 7, 9)]
    assert readers.regions(spark, folder("n2/r", "")).count() == 0
    assert rows(readers.regions(spark, folder("n3/r", "1 1 2 3\nx y 4 5\n"))) == [("1", 2, 3)]
    want, text = [], ""
    for k in range(50):
        pairs = [(k + i, 2 * k + i) for i in range(k % 6)]
        want += [(str(k), a, b) for a, b in pairs]
        text += f"{k} {len(pairs)}\n" + "".join(f"{a} {b}\n" for a, b in pairs)
    assert rows(readers.regions(spark, folder("n4/r", text))) == sorted(want)


def test_params():
    assert Params().align_min == 95 and Params(read_len=50).align_min == 47 and Params(align_threshold=60).align_min == 60


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "cluster int, read_id long, line string")
    sinks.cluster_file(m, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["cluster 1\t2", "x", "y"]
    sinks.tab_file(m, str(tmp_path / "t"), "read_id")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 2
    text = lambda name: [r.value for r in spark.read.text(str(tmp_path / name)).collect()]
    s = spark.createDataFrame([(1, 7, 9), (1, 8, 2)], "ctg_id int, sid int, score int")
    c = spark.createDataFrame([(1, "ACG"), (2, "AC")], "ctg_id int, s string")
    sinks.score_file(s, c, spark.createDataFrame([(1, "01")], "ctg_id int, bits string"), str(tmp_path / "s"))
    assert text("s") == ["1 3 01", "7 9", "2 2 ", ""]
    sinks.contig_score_file(s, c, str(tmp_path / "x"))
    assert text("x") == ["1 3 7 9", "2 2"]
    sinks.depth_file(spark.createDataFrame([(4, 2), (1, 4), (2, 0)], "pos int, depth int"), str(tmp_path / "d"))
    assert text("d") == ["1\t4", "4\t2", "3.0\t2"]
    sinks.fasta_file(c.where("ctg_id = 1"), str(tmp_path / "f"), "ctg_id", "s")
    assert text("f") == [">1", "ACG"]
    sinks.info_file(spark.createDataFrame([("b", 2, 5, "q"), ("a", 1, 9, "p")], "seqid string, taxid int, len int, path string"), str(tmp_path / "i"))
    assert text("i") == ["a\t1\t9\tp", "b\t2\t5\tq"]
    sinks.kmer_index(spark.createDataFrame([("ACG", 1)], "kmer string, item int"), "kmer_index_test", 4)
    assert spark.table("kmer_index_test").count() == 1
    spark.sql("DROP TABLE kmer_index_test")


def test_stream_equals_batch(spark, tmp_path):
    c = spark.createDataFrame([(1, "ACGTTGCAAC"), (2, "GGGGGCCCAT")], "doc long, s string")
    t = c.select(F.col("doc").alias("item"), F.substring("s", 1, 8).alias("s"))
    index = kmer.kmer_index(t, 4, "item").persist()
    how = {"k": 4, "width": 10, "least": 1, "owner": "doc", "target": "item"}
    c.write.parquet(str(tmp_path / "in"))
    got = []
    q = contigs.stream(spark, str(tmp_path / "in"), "doc long, s string", index, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "cp"), **how)
    q.awaitTermination(60)
    assert sorted(got) == rows(contigs.annotate(c, index, **how)) and got


@pytest.mark.parametrize("unit", [3, 8192])
def test_regions_in_units(spark, tmp_path, monkeypatch, unit):
    """Region files read in units of any size, as a sequential reader reads them; chains are followed over units, not over tokens."""
    from taxaloom.sources import readers

    monkeypatch.setattr(readers, "UNIT", unit)
    r = random.Random(unit)
    want = []
    for k in range(3):
        tokens = []
        for _ in range(30):
            n = r.choice([0, 1, 2, 7])
            tokens += [str(r.randrange(4)), str(n), *(str(r.randrange(9)) for _ in range(2 * n))]
        tokens += [["7", "999999999", "1", "2", "3"], ["8", "x", "1", "2"], ["9"]][k]
        i = 0
        while i + 1 < len(tokens) and tokens[i + 1].isdigit():
            n = int(tokens[i + 1])
            body = tokens[i + 2 : i + 2 + 2 * n]
            want += [(tokens[i], int(x), int(y)) for x, y in zip(body[::2], body[1::2], strict=False)]
            i += 2 * n + 2
        (tmp_path / f"{k}.txt").write_text("".join(t + r.choice([" ", "\n", " \n\n"]) for t in tokens))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        assert sorted(tuple(x) for x in readers.regions(spark, str(tmp_path)).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

"""Readers of the text formats of sequence annotation. Paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import region_of
from ..scratch import Scratch, written

SPACE = r"\s+"
#: Tokens of a region file that are looked at together.
UNIT = 8192


def offsets(df: DataFrame, size: Column, name: str = "at") -> DataFrame:
    """df with `name`: the sum of size over all rows before, in the order of the files. A running sum within each partition, and the partitions' totals, one row each."""
    m = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)).withColumn("__size", size.cast("long"))
    inside = F.sum("__size").over(W.partitionBy("__part").orderBy("__id")) - F.col("__size")
    totals = m.groupBy("__part").agg(F.sum("__size").alias("t"))
    before = totals.select("__part", (F.sum("t").over(W.orderBy("__part")) - F.col("t")).alias("__before"))
    return m.withColumn("__in", inside).join(before, "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__id", "__part", "__size", "__in", "__before")


def _in_blocks(lines: DataFrame) -> DataFrame:
    """Lines (value) of text files as (f, b, line, value): the file, the start of the block that a line was read in, and a number that rises within the block."""
    return lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("line"), "value")


def _records(lines: DataFrame) -> DataFrame:
    """(file, seq_id, header, seq): a record starts at a line that starts with `>`; lines before the first of a file belong to none.

    A line finds its header among the lines of its block, or it is the last header of the blocks before, one row each; so a record may span blocks."""
    t = _in_blocks(lines).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    head = F.when(F.startswith("value", F.lit(">")), F.col("line"))
    here = W.partitionBy("f", "b").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("own", F.last(head, ignorenulls=True).over(here))
    block = t.groupBy("f", "b").agg(F.max(head).alias("last"))
    before = W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = lambda c: F.last(F.when(F.col("last").isNotNull(), F.col(c)), ignorenulls=True).over(before)
    block = block.select("f", "b", carried("b").alias("carried_b"), carried("last").alias("carried"))
    t = t.join(block, ["f", "b"]).select("f", "b", "line", F.when(F.col("own").isNull(), F.col("carried_b")).otherwise(F.col("b")).alias("rb"), F.coalesce("own", "carried").alias("r"), "value").where("r is not null")
    of = F.when((F.col("line") == F.col("r")) & (F.col("b") == F.col("rb")), F.col("value"))
    ordered = F.array_sort(F.collect_list(F.when(of.isNull(), F.struct("b", "line", F.regexp_replace("value", SPACE, "").alias("v")))))
    r = t.groupBy("f", "rb", "r").agg(F.max(of).alias("header"), F.array_join(F.transform(ordered, lambda x: x["v"]), "").alias("seq"))
    header = F.substr("header", F.lit(2))
    return r.select(F.col("f").alias("file"), F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"), header.alias("header"), "seq")


def fasta(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(file, seq_id, header, seq): records of FASTA files; sequences may span lines, and headers may hold `>`."""
    return _records(spark.read.text(path)).where(F.length("seq") >= min_length)


def fasta_folder(spark: SparkSession, path: str, glob: str = "*.fna") -> DataFrame:
    """FASTA records of all files below a folder whose names match; files that start with a dot are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return _records(raw).select("file", "seq_id", "seq")


def single_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, seq) of files that hold one record each."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select("file", F.regexp_extract("value", r"^>?([^\r\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), SPACE, "").alias("seq"))


def two_line_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(n, title, seq) of the records of a file with one header line and one sequence line each, numbered from 0, up to the first empty line."""
    t = offsets(spark.read.text(path), F.lit(1), "n")
    end = t.where("trim(value) = ''").agg(F.min("n")).scalar()
    t = t.where(F.col("n") < F.coalesce(end, F.lit(2**62)))
    line = lambda k: F.max(F.when(F.col("n") % 2 == k, F.col("value")))
    r = t.groupBy(F.floor(F.col("n") / 2).alias("record")).agg(line(0).alias("title"), line(1).alias("seq"))
    return r.select(F.col("record").alias("n"), F.regexp_replace("title", "^>", "").alias("title"), "seq")


def titles(spark: SparkSession, path: str, reads: int) -> DataFrame:
    """(read_id, title) of the first `reads` reads of a two-line FASTA file; reads beyond its end have no row."""
    return two_line_fasta(spark, path).where(F.col("n") < reads).select(F.col("n").alias("read_id"), "title")


def first_read_length(spark: SparkSession, path: str) -> int:
    """The length of the first record of a file, 0 of an empty one. The lines behind its end are not joined or sorted."""
    t = _in_blocks(spark.read.text(path)).withColumn("at", F.struct("f", "b", "line"))
    starts = t.where(F.startswith("value", F.lit(">"))).select("at").orderBy("at").limit(2)
    first = starts.agg(F.min("at")).scalar()
    second = starts.agg(F.when(F.count(F.lit(1)) > 1, F.max("at"))).scalar()
    body = t.where((F.col("at") > first) & (second.isNull() | (F.col("at") < second)))
    return body.agg(F.coalesce(F.sum(F.length(F.regexp_replace("value", SPACE, ""))), F.lit(0))).first()[0]


def tokens(spark: SparkSession, path: str, schema: str, sep: str = SPACE) -> DataFrame:
    """Lines split at a separator, cast to the columns of the schema; blank lines and lines with too few fields are left out."""
    return _fields(spark.read.text(path), schema, sep)


def _fields(lines: DataFrame, schema: str, sep: str = SPACE, *kept: str) -> DataFrame:
    names = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    t = lines.where("trim(value) <> ''").select(*kept, F.split(F.trim("value"), sep).alias("t")).where(F.size("t") >= len(names))
    return t.select(*kept, *(F.col("t")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def seq_tax(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, taxid, len); of a repeated id the last line counts."""
    t = _fields(offsets(spark.read.text(path), F.lit(1), "n"), "filename string, seqid string, taxid int, len int", SPACE, "n")
    return t.groupBy("seqid").agg(F.max_by(F.struct("taxid", "len"), "n").alias("m")).select("seqid", "m.taxid", "m.len")


def longest(seq_tax: DataFrame) -> int:
    """The length of the longest sequence of a table of taxa, 0 of an empty one."""
    return seq_tax.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0]


def _token_units(lines: DataFrame) -> DataFrame:
    """(f, b, c, size, tokens, exits) of lines (f, b, t): runs of up to UNIT tokens of a block of a file, numbered from 0. A count n at a place leads to the count 2 n + 2 places on;
    exits: for each place, how far beyond the unit's end the chain from there arrives, -1 if it ends before, at a token that is no count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, c, left = None, None, 0, pa.array([], pa.string())

        def units(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal c, left
            while len(left) >= least and len(left):
                t, left = left[:UNIT], left[UNIT:]
                count, place = _counts(t), np.arange(len(t))
                to = np.where(count >= 0, place + 2 * count + 2, -1)
                while (inside := (to >= 0) & (to < len(t))).any():
                    to[inside] = to[to[inside]]
                exits = pa.ListArray.from_arrays([0, len(t)], pa.array(np.where(to >= 0, to - len(t), -1)))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([c], pa.int64()), pa.array([len(t)], pa.int64()), pa.ListArray.from_arrays([0, len(t)], t), exits], names=["f", "b", "c", "size", "tokens", "exits"])
                c += 1

        for batch in batches:
            f, b = pc.dictionary_encode(batch.column("f")), batch.column("b").to_numpy()
            key = f.indices.to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (b[1:] != b[:-1])) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = (batch.column("f")[lo].as_py(), int(b[lo]))
                if here != (file, block):
                    yield from units(1)
                    (file, block), c = here, 0
                left = pa.concat_arrays([left, batch.column("t").slice(lo, hi - lo).flatten()])
                yield from units(UNIT)
        yield from units(1)

    return lines.select("f", "b", "t").mapInArrow(run, "f string, b long, c long, size long, tokens array<string>, exits array<long>")


def _counts(tokens: pa.Array) -> np.ndarray:
    """The tokens as counts, -1 if they are none."""
    return pc.if_else(pc.match_substring_regex(tokens, "^[0-9]{1,9}$"), tokens, "-1").cast(pa.int64()).to_numpy(zero_copy_only=False).copy()


def _read_units(units: DataFrame) -> DataFrame:
    """(f, kind, i, n, seqid, start, end) of units (f, at, tokens, entry), entry being the place of the first count of a record in the unit, null if it has none: pairs of records that lie within
    the unit (kind 0), counts n of the others with their places i (1), and the tokens (seqid) that the others may need, with their places i (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(f: str, kind: int, i: np.ndarray, n: np.ndarray, seqid: pa.Array, start: pa.Array, end: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f] * len(i), pa.string()), pa.array(np.full(len(i), kind, np.int32)), pa.array(i, pa.int64()), pa.array(n, pa.int64()), seqid, start, end], names=["f", "kind", "i", "n", "seqid", "start", "end"])

        for batch in batches:
            for f, at, entry, tokens in zip(batch.column("f").to_pylist(), batch.column("at").to_pylist(), batch.column("entry").to_pylist(), batch.column("tokens"), strict=True):
                t = tokens.values
                count = _counts(t).tolist()
                found, j = [], len(t) if entry is None else entry - at
                while j < len(t) and count[j] >= 0:
                    found.append(j)
                    j += 2 * count[j] + 2
                j = np.array(found, np.int64)
                n = np.array([count[x] for x in found], np.int64)
                whole = (j > 0) & (j + 2 * n < len(t))
                none = lambda k: pa.nulls(k, pa.string())
                if whole.any():
                    k, m = j[whole], n[whole]
                    first, end = int(k[0]) - 1, int(k[-1] + 2 * m[-1]) + 1
                    mine = np.repeat(k, m)
                    pair = mine + 1 + 2 * (np.arange(len(mine)) - np.repeat(np.cumsum(m) - m, m))
                    yield rows(f, 0, mine + at, np.repeat(m, m), t.take(pa.array(mine - 1)), t.take(pa.array(pair)), t.take(pa.array(pair + 1)))
                else:
                    first, end = len(t), len(t)
                open_ = ~whole & (n > 0)
                yield rows(f, 1, j[open_] + at, n[open_], *(none(int(open_.sum())) for _ in range(3)))
                rest = np.unique(np.concatenate([np.arange(first), np.arange(end, len(t)), [len(t) - 1]]))
                yield rows(f, 2, rest + at, np.zeros(len(rest), np.int64), t.take(pa.array(rest)), none(len(rest)), none(len(rest)))

    return units.select("f", "at", "entry", "tokens").mapInArrow(run, "f string, kind int, i long, n long, seqid string, start string, end string")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, start, end) from records `seqid n` followed by n pairs, on the same or on following lines, any number of records a file.

    Only the counts tell where records start, since ids may be numbers: a count n leads to the count 2 n + 2 places on. Tokens are cut into units, and each unit finds for
    all of its places where the chain leaves it. So pointer jumping runs over units and the few places at which chains enter them, and not over tokens; then each unit that the file's
    chain enters is read from there. Records that do not lie within a unit are put together by joins.
    A record whose count is no number ends its file; pairs that the file does not hold are left out."""
    with Scratch(spark) as space:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.filter(F.split("value", SPACE), lambda x: x != "").alias("t"))
        cut = space.written(_token_units(lines))
        place = cut.select("f", "b", "c", "size").withColumn("end", F.sum("size").over(W.partitionBy("f").orderBy("b", "c")))
        place = space.written(place.withColumn("u", F.row_number().over(W.partitionBy("f").orderBy("b", "c")).cast("long")).withColumn("at", F.col("end") - F.col("size")))
        total = place.groupBy("f").agg(F.max("end").alias("total"))
        leads = cut.select("f", "b", "c", F.explode(F.array_distinct("exits")).alias("e")).where("e >= 0").join(place, ["f", "b", "c"]).select("f", (F.col("end") + F.col("e")).alias("j"))
        enters = leads.union(total.select("f", F.lit(1).cast("long").alias("j"))).distinct().join(total, "f").where("j < total").select("f", "j")
        enters = space.written(region_of(enters, place, "f", "j", "end", "u"))
        there = enters.join(place.select("f", "u", "b", "c", "at", "end"), ["f", "u"]).join(cut.select("f", "b", "c", "exits"), ["f", "b", "c"])
        jump = space.written(there.select("f", "j", F.get("exits", (F.col("j") - F.col("at")).cast("int")).alias("e"), "end").where("e >= 0").select("f", "j", (F.col("end") + F.col("e")).alias("to")))
        reached = total.select("f", F.lit(1).cast("long").alias("j"))
        while not jump.isEmpty():
            reached = space.written(reached.union(reached.join(jump, ["f", "j"]).select("f", F.col("to").alias("j"))))
            jump = space.written(jump.join(jump.select("f", F.col("j").alias("to"), F.col("to").alias("far")), ["f", "to"]).select("f", "j", F.col("far").alias("to")))
        entry = enters.join(reached, ["f", "j"]).select("f", "u", F.col("j").alias("entry"))
        units = cut.select("f", "b", "c", "tokens").join(place.select("f", "b", "c", "u", "at"), ["f", "b", "c"]).join(entry, ["f", "u"], "left")
        read = space.written(_read_units(units))
        token = read.where("kind = 2").select("f", "i", F.col("seqid").alias("x"))
        count = read.where("kind = 1").join(total, "f").select("f", (F.col("i") - 1).alias("i"), F.least("n", F.ceil((F.col("total") - F.col("i")) / 2)).alias("n")).where("n > 0")
        pair = token.join(count, ["f", "i"]).select("f", "i", F.col("x").alias("seqid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("p"))
        both = pair.select("f", "seqid", F.struct("i", "p").alias("pair"), F.explode(F.array(F.lit(0), F.lit(1))).alias("odd")).withColumn("i", F.col("pair.i") + 2 + 2 * F.col("pair.p") + F.col("odd"))
        half = lambda odd: F.max(F.when(F.col("odd") == odd, F.col("x").try_cast("int")))
        found = both.join(token, ["f", "i"]).groupBy("f", "pair", "seqid").agg(half(0).alias("start"), half(1).alias("end")).select("seqid", "start", "end")
        found = found.union(read.where("kind = 0").select("seqid", F.col("start").try_cast("int"), F.col("end").try_cast("int")))
        return written(found.where("start is not null and end is not null"))


def valid_regions(r: DataFrame, lengths: DataFrame) -> DataFrame:
    """Regions (1-based, inclusive) inside their sequence and longer than one base."""
    return r.join(lengths, "seqid").where("start >= 1 and `end` > start and `end` - 1 < len")


def index_info(spark: SparkSession, path: str) -> DataFrame:
    """(genome_idx, seqid, taxid, len, path): genome_idx is the line's number from 0."""
    p = offsets(spark.read.text(path), F.lit(1), "n").select(F.split("value", "\t").alias("t"), "n")
    return p.select(F.col("n").alias("genome_idx"), F.col("t")[0].alias("seqid"), F.col("t")[1].try_cast("int").alias("taxid"), F.col("t")[2].try_cast("int").alias("len"), F.col("t")[3].alias("path"))


def taxonomy_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tid, parent, rank) of a nodes.dmp."""
    t = spark.read.text(path).select(F.split("value", r"\t?\|\t?").alias("t"))
    return t.select(F.col("t")[0].try_cast("int").alias("tid"), F.col("t")[1].try_cast("int").alias("parent"), F.col("t")[2].alias("rank")).where("tid is not null")


def matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(k, i, j, value) of row-major n x n matrices, one after another; line ends have no meaning."""
    t = spark.read.text(path).select(F.filter(F.split("value", SPACE), lambda x: x != "").alias("t"))
    p = offsets(t, F.size("t")).select("at", F.posexplode("t").alias("p", "x")).select((F.col("at") + F.col("p")).alias("p"), "x")
    return p.select(F.floor(F.col("p") / (n * n)).cast("int").alias("k"), (F.floor(F.col("p") / n) % n).cast("int").alias("i"), (F.col("p") % n).cast("int").alias("j"), F.col("x").try_cast("double").alias("value"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    return tokens(spark, path, "u long, v long")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return tokens(spark, path, "rid long, type int, newtype int")


def bins(spark: SparkSession, path: str) -> DataFrame:
    return tokens(spark, path, "ctgid long, ctgnum int")


def catalogue(spark: SparkSession, path: str, domain: str = "Bacteria") -> DataFrame:
    """(stem, id, lineage, completeness, species, subdir) of complete genomes of a domain; lineage names carry their level."""
    from ..functions import sequence as S

    t = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("t"))
    c = t.select(F.col("t")[0].alias("stem"), F.col("t")[1].alias("id"), F.col("t")[2].alias("names"), F.col("t")[3].try_cast("long").alias("completeness"), F.col("t")[4].alias("species"), F.col("t")[5].alias("subdir"))
    c = c.where("completeness >= 0 and names <> ''").withColumn("lineage", S.unique_names(S.split_names(F.col("names"), ";")))
    return c.where(F.col("lineage")[0] == domain).drop("names")


def catalogue_edges(c: DataFrame) -> DataFrame:
    """Distinct (level, parent, child) of the lineages, the genome's id below its species."""
    full = F.concat("lineage", F.array("id"))
    e = c.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(full) - 1), lambda i: F.struct((i - 1).alias("level"), F.element_at(full, i).alias("parent"), F.element_at(full, i + 1).alias("child")))).alias("e"))
    return e.select("e.level", "e.parent", "e.child").distinct()


def count_report(spark: SparkSession, path: str) -> DataFrame:
    """(count, lineage): a count and a lineage of any depth per line."""
    t = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("t"))
    return t.select(F.trim(F.col("t")[0]).try_cast("long").alias("count"), F.transform(F.slice("t", 2, F.size("t")), lambda x: F.trim(x)).alias("lineage")).where("count is not null")


def lcp_intervals(spark: SparkSession, path: str) -> DataFrame:
    return tokens(spark, path, "depth int, lb int, rb int, lstart int, rstart int")


def frequent_kmers(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, gene): the gene that a frequent k-mer stands for."""
    return tokens(spark, path, "kmer string, gene long")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    return tokens(spark, path, "gi string, len int")


def species_labels(spark: SparkSession, path: str) -> DataFrame:
    return tokens(spark, path, "contig string, species string", "\t")


def gene_hits(spark: SparkSession, path: str) -> DataFrame:
    """(contig, gene, identity): the contig is the fragment's first two fields."""
    t = tokens(spark, path, "fragment string, gene string, identity double", "\t")
    return t.withColumn("contig", F.substring_index("fragment", "_", 2))


def optional_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet index, or an empty one if the path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

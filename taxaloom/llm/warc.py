"""WARC archives: writing pages as records, and reading records back by boundary-chain verification.

Writing: every page is one record; of pages with equal payloads the one with the smallest id is a response
and the others are revisits of it. Spark's text writer joins the records, so the files are
plain, splittable WARC 1.1.

Reading: the files are split at the magic "WARC/1.1" by Spark's text reader, wherever that string stands, so a
payload that holds it yields false candidates. Each candidate's absolute offset is the sum of the lengths
before it, and its header names the offset of its successor. Pointer jumping from the start of each
file (following 1, 2, 4, ... successors at a time) keeps the candidates that can be reached; all others
are payload. Payloads that the split had cut are put together again.

Null html is an empty payload. Repeated rows of a response's id, url and payload are responses too.
Null ids are written as an empty id and read back as null; they sort last. An empty table gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, scratch, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 2000
#: A list of at most this many payloads that occur again is broadcast; beyond it pages are shuffled, each payload's over COPY_SALTS keys.
BROADCAST_COPIES, COPY_SALTS = 100_000, 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digits: Column) -> Column:
    """Base-32 of 40 hex digits: 8 groups of 20 bits, 4 letters each."""
    parts = []
    for g in range(8):
        value = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to): refers_to is null for responses.

    A payload of fewer than least_bytes bytes is always a response."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("hash", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    p = p.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("id"), F.xxhash64("url").alias("u"), F.col("url").alias("url"))
    first = p.where(F.col("bytes") >= least_bytes).groupBy("hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only payloads that occur again have a row here.
    first = written(first.select("hash", "first"))
    if first.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        j = p.join(F.broadcast(first), "hash", "left")
    else:
        salts = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))))
        j = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(COPY_SALTS)).cast("int")).join(salts, ["hash", "salt"], "left")
    own = (F.col("first").isNull()) | (F.col("first") == order)
    return j.select("page_id", "url", "payload", "bytes", "digest", "hash", F.when(~own, F.col("first.id")).alias("refers_to"), (~own).alias("revisit"))


def record(page: DataFrame) -> Column:
    """The text of a record, without the two line ends after its block."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page_id = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("revisit")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id, F.lit(">"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">"))), line("X-Payload-Length", F.col("bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record per page below path, RECORDS_PER_FILE to a file."""
    classified(pages, least_bytes).select(record(pages).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, off, value): what follows each magic, and the magic's offset in its file."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return raw.withColumn("size", F.octet_length("value").cast("long") + len(MAGIC))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds off: rows tile each file, so the offset of a row is the sum of the sizes before it, less the magic that starts it."""
    rows = rows.withColumn("in_block", F.sum("size").over(Window.partitionBy("file", "block").orderBy("seq")) - F.col("size"))
    block = rows.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    start = block.withColumn("from", F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).select("file", "block", "from")
    return rows.join(start, ["file", "block"]).withColumn("off", F.col("from") + F.col("in_block") - len(MAGIC)).drop("in_block", "from")


def field(header: Column, name: str) -> Column:
    """The value of a header field, or null."""
    value = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def parsed(rows: DataFrame) -> DataFrame:
    """Header, length of the block, and the digest of the payload if it stands whole in this row."""
    head = F.substring_index("value", END, 1)
    rows = rows.withColumn("header", F.when(F.instr("value", END) > 0, head)).withColumn("length", field(F.col("header"), "Content-Length").try_cast("long"))
    rows = rows.withColumn("body", F.octet_length("header").cast("long") + len(END))
    whole = F.octet_length("value") >= F.col("body") + F.col("length")
    payload = F.substring(F.col("value").cast("binary"), (F.col("body") + 1).cast("int"), F.col("length").cast("int"))
    return rows.withColumn("digest", F.when(whole, F.sha1(payload))).withColumn("next", F.col("body") + F.col("length") + len(MAGIC) + len(END))


def reached(chain: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chain from the start of each file. chain: (file, off, next)."""
    with Scratch(chain.sparkSession) as space:
        return written(_jumped(space, chain).where("live").select("file", "off"))


def _jumped(space: Scratch, chain: DataFrame) -> DataFrame:
    """(file, off, next, live) after as many jumps as reach no more candidates."""
    state = space.written(chain.select("file", "off", "next", (F.col("off") == 0).alias("live")))
    known = -1
    while True:
        n = state.where("live").count()
        if n == known:
            return state
        known = n
        a, b = state.alias("a"), state.select(F.col("file").alias("f"), F.col("off").alias("o"), F.col("next").alias("far")).alias("b")
        jumped = a.join(b, (F.col("a.file") == F.col("b.f")) & (F.col("a.next") == F.col("b.o")), "left").select("a.file", "a.off", "a.live", "a.next", "b.far")
        kept = jumped.select("file", "off", F.col("far").alias("next"), "live")
        hit = jumped.where("live and next is not null").select("file", F.col("next").alias("off"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("live"), F.lit(False).alias("real"))
        merged = kept.withColumn("real", F.lit(True)).unionByName(hit).groupBy("file", "off").agg(F.max("next").alias("next"), F.max("live").alias("live"), F.max("real").alias("real"))
        state = space.written(merged.where("real").select("file", "off", "next", "live"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, header, length, digest): the true records of the archives; digest is the hex SHA-1 of the block."""
    rows = parsed(candidates(spark, path))
    parts = written(_placed(rows.drop("value")).where("off >= 0").select("file", "off", "header", "length", "digest", (F.col("off") + F.col("next")).alias("next")))
    true = written(parts.join(reached(parts.where("length is not null").select("file", "off", "next")), ["file", "off"]))
    cut = true.where("digest is null")
    if cut.isEmpty():
        return true.drop("next")
    # Payloads that hold the magic: the rows between a record and its successor, joined with the magic again.
    again = _placed(candidates(spark, path).join(cut.select("file").distinct(), "file", "left_semi"))
    spans = cut.select("file", F.col("off").alias("start"), "next")
    # Each row belongs to the last true record at or before it in its file.
    owner = Window.partitionBy("file").orderBy("off")
    marks = again.select("file", "off").join(true.select("file", "off", F.col("off").alias("start")), ["file", "off"], "left")
    marks = marks.withColumn("start", F.last("start", ignorenulls=True).over(owner)).join(spans, ["file", "start"])
    pieces = again.select("file", "off", "value").join(marks, ["file", "off"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), MAGIC)
    joined = pieces.groupBy("file", "start").agg(text.alias("value")).select("file", F.col("start").alias("off"), "value")
    mended = parsed(joined).select("file", "off", "header", "length", "digest")
    return true.where("digest is not null").select("file", "off", "header", "length", "digest").union(mended)


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the records read; of a revisit, the full payload's figures stand in its header."""
    h = F.col("header")
    kind = field(h, "WARC-Type")
    page_id = lambda name: F.regexp_extract(h, rf"(?i)\r\n{name}: <urn:page:(-?\d*)>", 1).try_cast("long")
    revisit = kind == "revisit"
    return records.select(
        page_id("WARC-Record-ID").alias("page_id"),
        F.when(revisit, field(h, "X-Payload-Length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(field(h, "WARC-Payload-Digest"), ":", -1)).otherwise(base32_of_hex(F.col("digest"))).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(revisit, page_id("WARC-Refers-To")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    path = scratch(pages.sparkSession)
    write(pages, path, least_bytes)
    return pages_of(read(pages.sparkSession, path))

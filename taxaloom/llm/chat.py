"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON object in any of several layouts: a prompt with a response, an instruction with input
and output, a list of messages, and so on. The hash of its nested field paths (names without types, from the
parsed value) selects a declared layout, whose mapping gives the canonical turns (role, text). Records
of a layout that is not declared, and those that are no valid JSON, have null turns, formatted text and masks.
Texts have no length limit of their own: long records are reduced to their field names before the fingerprint is taken. A conversation
must fit in one row: its record in 2^30 characters, which Spark's string functions hold, and its turns without texts in the 128 MiB of a variant
(some millions of turns). Beyond that a record of as_records raises an error (`strict`).

The template writes `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so control strings never occur inside; a newline in a role becomes `\\n`. The
loss mask is a list of (start, length) spans in code points: the texts of the assistant's turns.

Null texts and roles read as empty, null turn numbers sort first, and equal turn numbers sort by role and text.
Repeated rows are repeated turns. Conversations with a null id form one conversation. An empty table gives no row.
Records that already have a column that is added are refused; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse_clash

START, END = "<|im_start|>", "<|im_end|>"
TURN = "role string, text string"
#: Records over this many bytes are parsed for their paths without their texts, as parsed values have limits (20,000,000 characters, 128 MiB).
LONG = 1 << 24
JSON = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "__broken"}
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


def blanked(value: Column) -> Column:
    """A JSON text with empty strings as values; names stay. Possessive, so that it needs no stack."""
    return F.regexp_replace(value, rf'(?s)("{_INSIDE}"\s*+:)|("){_INSIDE}(")', "$1$2$3")


def paths(value: Column) -> Column:
    """The nested field names of a JSON text, without types: from the schema of its variant."""
    schema = F.schema_of_variant(F.try_parse_json(F.when(F.octet_length(value) > LONG, blanked(value)).otherwise(value)))
    return F.regexp_replace(F.regexp_replace(schema, r"OBJECT<|ARRAY<", "<"), r"\b(STRING|VOID|BIGINT|BOOLEAN|DOUBLE|VARIANT|DECIMAL\(\d+,\d+\)|DECIMAL|FLOAT|INT|OBJECT|ARRAY)\b", "")


def fingerprint(value: Column) -> Column:
    return F.xxhash64(paths(value))


def _fields(*pairs: tuple[str, str]):
    """A mapping from single fields to turns."""
    schema = ", ".join(f"`{name}` string" for name, _ in pairs)

    def turns(value: Column) -> Column:
        x = F.from_json(value, f"{schema}, __broken string", JSON)
        return F.when(x["__broken"].isNull(), F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(x[name], F.lit("")).alias("text")) for name, role in pairs)))

    return turns


def _messages(name: str, role: str, text: str, roles: dict[str, str] | None = None):
    """A mapping from a list of objects to turns."""

    def turns(value: Column) -> Column:
        x = F.from_json(value, f"`{name}` array<struct<`{role}`: string, `{text}`: string>>, __broken string", JSON)
        as_role = lambda r: F.coalesce(*(F.when(r == a, b) for a, b in (roles or {}).items()), r, F.lit(""))
        return F.when(x["__broken"].isNull(), F.transform(x[name], lambda m: F.struct(as_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))))

    return turns


_SHARED = {"human": "user", "gpt": "assistant"}
#: Examples that declare a layout's field paths, and the mapping to turns.
LAYOUTS = [
    (['{"prompt":"","response":""}'], _fields(("prompt", "user"), ("response", "assistant"))),
    (['{"prompt":"","completion":""}'], _fields(("prompt", "user"), ("completion", "assistant"))),
    (['{"question":"","answer":""}'], _fields(("question", "user"), ("answer", "assistant"))),
    (['{"instruction":"","output":""}'], _fields(("instruction", "user"), ("output", "assistant"))),
    (['{"instruction":"","input":"","output":""}'], _fields(("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    (['{"messages":[{"role":"","content":""}]}', '{"messages":[]}'], _messages("messages", "role", "content")),
    (['{"conversations":[{"from":"","value":""}]}', '{"conversations":[]}'], _messages("conversations", "from", "value", _SHARED)),
]


def canonical(records: DataFrame, record: str = "record", strict: bool = False) -> DataFrame:
    """All columns of records, fingerprint and turns. Where strict, as for records that were built here, a record without turns is an error."""
    refuse_clash(records, "fingerprint", "turns")
    r = records.withColumn("fingerprint", fingerprint(F.col(record)))
    turns = F.lit(None).cast(f"array<struct<{TURN.replace(' string', ': string')}>>")
    for examples, mapping in LAYOUTS:
        known = F.array(*(fingerprint(F.lit(e)) for e in examples))
        turns = F.when(F.array_contains(known, F.col("fingerprint")), mapping(F.col(record))).otherwise(turns)
    if strict:
        turns = F.coalesce(turns, F.raise_error(F.concat(F.lit("a conversation's record can't be parsed; its bytes: "), F.coalesce(F.octet_length(F.col(record)).cast("string"), F.lit("null")))))
    return r.withColumn("turns", turns)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """The inverse of escaped, and of its newline rule for roles: pairs of backslashes are read first, from the left."""
    part = lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def formatted(turns: DataFrame) -> DataFrame:
    """All columns of turns (with `turns`), formatted and loss_mask."""
    refuse_clash(turns, "formatted", "loss_mask")
    role = lambda t: F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n"))
    piece = lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn"))
    d = turns.withColumn("__p", F.transform("turns", piece))
    whole = F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    grow = lambda a, p: F.struct((a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).alias("at"), F.when(p["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"))
    return d.withColumn("formatted", whole).withColumn("loss_mask", F.aggregate("__p", start, grow, lambda a: a["spans"])).drop("__p")


def read_back(text: Column) -> Column:
    """The turns that a formatted text holds."""
    blocks = F.filter(F.split(text, r"<\|im_start\|>"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(unescaped(F.substring_index(b, "\n", 1)).alias("role"), unescaped(F.substring_index(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2), END, 1)).alias("text")))


def masked(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(text, m["start"] + 1, m["length"]))), "")


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as JSON records. A single exchange becomes a prompt with its response, an exchange after a system
    turn an instruction with input and output, all else a list of messages."""
    r = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    c = r.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.transform("t", lambda t: F.replace(t["role"], F.lit(","), F.lit(",,"))), ",")
    t = lambda k: F.get("t", F.lit(k))["text"]
    record = (
        F.when(roles == "user,assistant", F.to_json(F.struct(t(0).alias("prompt"), t(1).alias("response"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(t(0).alias("instruction"), t(1).alias("input"), t(2).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return c.select("conv_id", record.alias("record"))


def digests(done: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts."""
    d = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), masked(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))

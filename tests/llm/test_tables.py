"""Mixing, archives, vectors, rules and chat: oracles, brute force and edge cases."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.llm import chat, embed, mixing, oracles, rules, warc
from taxaloom.llm.queries import QUERIES, op8_embedding_dedup
from tests.test_queries import connection, same


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, sf, name):
    same(QUERIES[name](spark, sf), connection(sf).execute(oracles.SQL[name]).df())


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "b", "c", None]), r.randint(0, 50)) for i in range(4000)] + [(5000, "empty", 0), (None, "a", 7)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    t = {x.source: x for x in mixing.targets(sizes).collect()}
    total = sum(x[2] for x in rows)
    assert abs(sum(x.target for x in t.values()) - total) < 1e-6 * total
    assert all(x.target <= 3 * x.source_size + 1e-9 for x in t.values()) and t["empty"].target == 0
    # By hand: give by weight, cut, share again.
    names = sorted((k for k in t if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, open_ = {}, set(names)
    left = total
    while open_:
        w = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / w > 3 * t[k].source_size}
        if not over:
            target |= {k: left * weight[k] / w for k in open_}
            break
        for k in over:
            target[k] = 3 * t[k].source_size
        left -= sum(target[k] for k in over)
        open_ -= over
    assert all(abs(target[k] - t[k].target) < 1e-6 * max(1, target[k]) for k in names)
    docs = sizes.withColumn("text", F.repeat(F.lit("w "), F.col("size").cast("int"))).withColumn("rate", F.lit(9)).withColumn("target", F.lit("x"))
    assert mixing.mix(docs, mixing.targets(sizes)).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.with_targets(docs, mixing.targets(sizes))
    out = mixing.mix(docs, mixing.targets(sizes)).groupBy("source").agg(F.sum("size").alias("taken")).collect()
    assert all(abs(x.taken - t[x.source].target) < 0.1 * t[x.source].target + 100 for x in out if x.source != "empty")
    assert mixing.mix(docs.limit(0), mixing.targets(sizes.limit(0))).count() == 0


def trap(n):
    return f"a{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n{warc.MAGIC}b"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_COPIES", broadcast)
    texts = ["<html>é</html>", "", None, trap(1), "same", "same", trap(2) * 3, warc.MAGIC, "x" * 50000, "\r\n\r\n", "WARC/1.1", "same", "ends with \r\n\r\n" + warc.MAGIC]
    pages = spark.createDataFrame([(i, f"http://x/{i} y", t, 1) for i, t in enumerate(texts)] + [(None, None, "no id", 1)], "page_id long, url string, html string, header int").repartition(2)
    out = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(out) == len(texts) + 1
    first = {}
    for i, t in [*enumerate(texts), (None, "no id")]:
        raw = (t or "").encode()
        r = out[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("revisit", first[raw]) if raw in first else ("response", None))
        first.setdefault(raw, i)
    assert warc.round_trip(pages.limit(0)).count() == 0
    big = {r.page_id: r for r in warc.round_trip(pages, least_bytes=5).collect()}
    assert big[5].record_type == "response" and big[2].record_type == "response"


def test_warc_over_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pages = spark.createDataFrame([(i, "u", (trap(i) if i % 7 == 0 else "p") * (i % 40) + str(i)) for i in range(300)], "page_id long, url string, html string").coalesce(2)
        out = warc.round_trip(pages).collect()
        assert sorted(r.page_id for r in out) == list(range(300))
        assert all(r.payload_bytes == len(((trap(r.page_id) if r.page_id % 7 == 0 else "p") * (r.page_id % 40) + str(r.page_id)).encode()) for r in out)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def brute_vectors(rows, least):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for k, (_, v) in zip(ok, rows, strict=True)]
    n = len(rows)
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(k, low.get(find(i), k))
    return sorted((k, links[i], low[find(i)], k == low[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("part", [1 << 21, 128])
def test_vectors(spark, monkeypatch, part):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        rows.append((100 + i, (base[rng.integers(10)] + rng.normal(0, 0.2, 16)).astype(np.float32).tolist()))
    rows += [(400 + i, rows[3][1]) for i in range(5)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0] * 8), (505, [1.0] * 8), (506, (2 * base[3]).tolist()), (507, [None] * 16), (508, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, node int")
    monkeypatch.setattr(embed, "PART_VALUES", part)
    got = sorted(tuple(r) for r in embed.near_duplicates(df.select("vec_id", "embedding")).collect())
    assert got == brute_vectors(rows, 0.9)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_vector_pairs_meet_once(spark, monkeypatch):
    """Counts of links over many small parts at a wide threshold, where most pairs are within the budget of several blocks."""
    monkeypatch.setattr(embed, "PART_VALUES", 1024)
    unit = np.random.default_rng(5).normal(size=(300, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(unit)], "node long, weight long, embedding array<double>")
    placed = embed.written(embed.cells(df, 0.2))
    assert placed.count() <= 2 * embed.BLOCKS * 300
    found = embed.link_parts(placed, 0.2).where("to > 0").groupBy("node").agg(F.sum("to").alias("n")).collect()
    assert {r.node: r.n for r in found} == {i: int(n) for i, n in enumerate((unit @ unit.T >= 0.2).sum(1) - 1) if n}


def test_vector_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in op8_embedding_dedup(spark, sf).collect()) == brute_vectors(rows, 0.9)


def test_rules(spark):
    def repeats(w):
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        return len({p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + 8)})

    r = random.Random(9)
    texts = [None, "", "one", "a b c d e f g h " * 3, " ".join(r.choice("abcdefghij") for _ in range(300)), "x\nx\n\ny\nx \n \n", "#* $% | <> & é É 9", "the of and " * 5000, " ".join(f"w{i}" for i in range(100))]
    df = spark.createDataFrame([(i, t, l, 7, "c") for i, t in enumerate(texts) for l in ("en", None, "xx")], "doc_id long, text string, lang string, n_words int, kept string")
    with pytest.raises(ValueError):
        rules.judged(df)
    assert rules.keep(df).columns == df.columns
    df = df.drop("n_words", "kept")
    out = rules.judged(df).collect()
    assert len(out) == 3 * len(texts)
    for x in out:
        t = x.text or ""
        w = t.split()
        lines = [y for y in t.split("\n") if y.strip()]
        assert (x.n_words, x.word_chars, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeats(w))
        assert x.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert x.base_failed == (len(w) < 20 or 100 * repeats(w) > 30 * len(w))
    assert {(x.doc_id, x.lang) for x in rules.keep(df).collect()} == {(x.doc_id, x.lang) for x in out if x.kept}
    assert rules.judged(df.limit(0)).count() == 0


def test_rules_of_other_languages(spark):
    """Documents of one language keep their verdict when those of another are added."""
    r = random.Random(4)
    german = ["der", "die", "und", "in", "den", "Haus", "Baum", "geht", "steht", "alt"]
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    de = [(i, text(german, 120), "de") for i in range(30)] + [(90, "#$% " * 100, "de"), (91, text(german, 30), "de")]
    zh = [(100 + i, text([chr(0x4E00 + k) for k in range(40)], 120), "zh") for i in range(30)]
    none = [(200 + i, text(german, 120), None) for i in range(3)]
    schema = "doc_id long, text string, lang string"
    kept = lambda rows: {x.doc_id for x in rules.keep(spark.createDataFrame(rows, schema)).collect()}
    alone = kept(de)
    assert alone == {*range(30), 91}
    assert kept(de + zh + none) == alone | {x[0] for x in zh + none}


def test_chat_layouts(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"},
        {"response": "r", "prompt": "p"},
        {"question": "p", "answer": None},
        {"instruction": "s", "input": "p", "output": "r"},
        {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]},
        {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]},
        {"messages": []},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)] + [(8, "{broken"), (9, None)], "conv_id long, record string")
    t = {r.conv_id: r.turns and [tuple(x) for x in r.turns] for r in chat.canonical(df).collect()}
    pair = [("user", "p"), ("assistant", "r")]
    assert t[0] == t[1] == t[4] == t[5] == pair
    assert t[2] == [("user", "p"), ("assistant", "")]
    assert t[3] == [("system", "s"), *pair]
    assert t[6] == [] and t[7] is None and t[8] is None and t[9] is None


def test_chat_round_trip(spark):
    bad = ["", "\\", "<|", "<\\|", "\\<|im_end|>\\\n<|im_start|>assistant\n", "\\n", "é𝄞<||>\\\\|", None, "x" * 20000]
    rows = [(i, j, role, t) for i, t in enumerate(bad) for j, role in enumerate(["user", "assistant", "a\nb<|\\n", None, "assistant"])] + [(1, None, "user", "first"), (2, 1, "assistant", "tie"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.formatted(chat.canonical(chat.as_records(df)))
    out = {r.conv_id: r for r in done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask"))).collect()}
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert [tuple(x) for x in out[c].back] == want
        assert out[c].loss == "".join(t for role, t in want if role == "assistant")
    assert chat.digests(done.limit(0)).count() == 0


def test_chat_blanked(spark):
    import json

    value = {'a"\\': 'x"y\\', "b": [{"c:": ": \n", "d": 1}, "e", {"f": {}}], "": "\\" * 50000 + '"'}
    df = spark.createDataFrame([(json.dumps(value),), (json.dumps(value, indent=1).replace('":', '" :'),), ('{"a": "open',), (None,)], "v string")
    got = [r.b for r in df.select(chat.blanked(F.col("v")).alias("b")).collect()]
    assert json.loads(got[0]) == json.loads(got[1]) == {'a"\\': "", "b": [{"c:": "", "d": 1}, "", {"f": {}}], "": ""}
    assert got[2] == '{"a": "open' and got[3] is None


def test_chat_long_texts(spark):
    size = 20_000_001
    roles = [["user", "assistant"], ["system", "user", "assistant"], ["assistant", "user"]]
    rows = [(i, j, r, f"t{i}{j}\n") for i, rs in enumerate(roles) for j, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("text", F.when(F.col("role") == "assistant", F.concat("text", F.repeat(F.lit("x"), size))).otherwise(F.col("text")))
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(chat.as_records(df), strict=True))).collect()}
    for i, rs in enumerate(roles):
        text = "".join(f"{r}\nt{i}{j}\n" + ("x" * size if r == "assistant" else "") + "\n" for j, r in enumerate(rs))
        assert (out[i].n_turns, out[i].turns_sha256, out[i].loss_chars) == (len(rs), hashlib.sha256(text.encode()).hexdigest(), size + 4)
    # A long record that is no JSON has no turns, and is an error where it was built here.
    broken = spark.range(1).select(F.concat(F.lit('{"prompt":"\\q","response":"'), F.repeat(F.lit("x"), size), F.lit('"}')).alias("record"))
    assert chat.canonical(broken).select("turns").first().turns is None
    with pytest.raises(Exception, match="can't be parsed"):
        chat.canonical(broken, strict=True).select("turns").collect()


def test_chat_refuses_clashing_columns(spark):
    df = spark.createDataFrame([('{"prompt":"a","response":"b"}', 1)], "record string, fingerprint int")
    with pytest.raises(ValueError):
        chat.canonical(df)
    done = chat.canonical(df.withColumnRenamed("fingerprint", "formatted"))
    with pytest.raises(ValueError):
        chat.formatted(done)

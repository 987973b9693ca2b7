"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a document, of character classes and of the common words of its language, are compared with
those of the language as a whole by the Jensen-Shannon distance (base 2, 0 to 1). The common words of a language are the
COMMON words that most of its documents of MIN_WORDS words or more hold (A-Z lower-cased; ties: first by code point), so any language
has its own, learned from the corpus, and no language's documents change another's verdicts. The language's
histograms are the sums over all its documents that pass the base rules and are long enough. A document
is kept if it passes the base rules and both distances stay within their limits; below MIN_WORDS words
histograms scatter too much to judge, and only the base rules decide.

Base rules: fewer than 20 words, or more than 30 % of the words in 8-word windows that occur twice or more.
A document without a language is judged by the base rules alone and is in no reference.
Null and empty texts have no words and fail. A language without reference documents is not judged by distance.
Repeated rows are judged alike, each by itself. Texts are measured whole, whatever their length. An empty table gives an empty result.
Documents with a column that `judged` adds are refused; `keep` passes all columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, listed, refuse_clash, row_hash, written

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Common words of a language.
COMMON = 10
CLASS_LIMIT, WORD_LIMIT = 0.21, 0.27
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A table of languages of at most this many rows is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common): the COMMON words of each language, those in most documents first."""
    d = docs.where("lang is not null").select("lang", split_words(F.col("text")).alias("w")).where(F.size("w") >= MIN_WORDS)
    held = d.select("lang", F.explode(F.array_distinct(F.transform("w", lambda w: F.translate(w, _UPPER, _LOWER)))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    top = held.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("common"))


def with_language(df: DataFrame, languages: DataFrame) -> DataFrame:
    """df joined to its language's row, null where there is none; a short table of languages is broadcast after it has been counted."""
    named = languages.withColumnRenamed("lang", "__lang")
    if named.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        named = F.broadcast(named)
    return df.join(named, F.col("lang") == F.col("__lang"), "left").drop("__lang")


def measured(docs: DataFrame, words: DataFrame) -> DataFrame:
    """All columns of docs and COUNTS, `classes` and `common` (histograms, arrays of long). words: common_words of the corpus."""
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    d = with_language(docs, words.withColumnRenamed("common", "__c")).select(*names, "__c", split_words(text).alias("__w"), F.split(text, "\n").alias("__l"), F.length(text).alias("__size"))
    d = d.select("*", F.size("__w").cast("long").alias("n_words"), F.array_join("__w", "").alias("__j"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__wh"), F.transform(F.filter("__l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)).alias("__lh"))
    # Class by class is taken out of what is left, so that only the first pass reads the whole text.
    d = d.select("*", F.regexp_replace("__j", r"\p{Ll}+", "").alias("__r"))
    for k, pattern in enumerate([r"\p{Lu}+", r"[#*$%&|<>]+", r"\p{Nd}+"]):
        d = d.select("*", F.regexp_replace("__r" if k == 0 else f"__r{k}", pattern, "").alias(f"__r{k + 1}"))
    size = F.length
    classes = F.array(*(x.cast("long") for x in (F.col("__size") - size("__j"), size("__j") - size("__r"), size("__r") - size("__r1"), size("__r1") - size("__r2"), size("__r2") - size("__r3"), size("__r3"))))
    # Windows of eight words, by the hashes of their words.
    window = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*(F.col("__wh")[i + k] for k in range(WINDOW)))))
    place = F.filter(F.transform("__w", lambda w: F.array_position("__c", F.translate(w, _UPPER, _LOWER))), lambda p: p > 0)
    d = d.select(*names, "n_words", F.size(F.col("__lh")).alias("__nl"), F.size(F.array_distinct("__lh")).alias("__dl"), size("__j").cast("long").alias("word_chars"), classes.alias("classes"), window.alias("__win"), F.coalesce(place, F.array().cast("array<long>")).alias("__codes"))
    d = d.select(*names, "n_words", "word_chars", "classes", (F.col("__nl") - F.col("__dl")).cast("long").alias("n_dup_lines"), F.col("classes")[3].alias("n_symbols"), "__win", "__codes", (F.size(F.array_distinct("__win")) < F.size("__win")).alias("__twice"))
    common = F.concat(F.transform(F.sequence(F.lit(1), F.lit(COMMON)), lambda c: F.size(F.filter("__codes", lambda x: x == c)).cast("long")), F.array(F.col("n_words") - F.size("__codes")))
    d = d.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "classes", common.alias("common"), F.when(F.col("__twice"), F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    same = lambda x, k, o: F.coalesce(F.get("__s", k + o)["h"] == x["h"], F.lit(False))
    d = d.select("*", F.sort_array(F.transform(F.filter("__s", lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"])).alias("__p"))
    run = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return d.select(*names, *(c for c in COUNTS if c != "n_repeat_words"), F.coalesce(run, F.lit(0)).cast("long").alias("n_repeat_words"), "classes", "common")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(m: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): one row for each language."""
    good = m.where(~base_failed() & (F.col("n_words") >= MIN_WORDS) & F.col("lang").isNotNull())
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(6)] + [F.sum(F.col("common")[k]).alias(f"w{k}") for k in range(COMMON + 1)]
    total = good.groupBy("lang").agg(*sums)
    return total.select("lang", F.array(*(F.col(f"c{k}") for k in range(6))).alias("ref_classes"), F.array(*(F.col(f"w{k}") for k in range(COMMON + 1))).alias("ref_common"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if one is null, 0 if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    pair = F.zip_with(a, b, lambda x, y: F.struct((x / total(a)).alias("p"), (y / total(b)).alias("q")))
    term = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    sum_ = F.aggregate(pair, F.lit(0.0), lambda s, v: s + term(v["p"], v["q"]) + term(v["q"], v["p"]))
    return F.when(a.isNull() | b.isNull(), None).when((total(a) == 0) | (total(b) == 0), 0.0).otherwise(F.sqrt(F.greatest(sum_ / 2, F.lit(0.0))))


def verdicts(m: DataFrame) -> DataFrame:
    """m, the measured documents as written, with distances to their language and the verdicts."""
    j = with_language(m, references(m))
    j = j.withColumn("class_distance", distance(F.col("classes"), F.col("ref_classes"))).withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
    j = j.withColumn("base_failed", base_failed())
    far = (F.col("n_words") >= MIN_WORDS) & ((F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT))
    return j.withColumn("kept", ~F.col("base_failed") & ~far)


def with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def judged(docs: DataFrame) -> DataFrame:
    """All columns of docs, COUNTS, class_distance, word_distance, base_failed and kept."""
    extra = [*COUNTS, "class_distance", "word_distance", "base_failed", "kept"]
    refuse_clash(docs, *extra, "classes", "common", "ref_classes", "ref_common")
    with Scratch(docs.sparkSession) as space:
        words = space.written(common_words(with_lang(docs)))
        m = written(measured(with_lang(docs), words))
    return verdicts(m).select(*docs.columns, *extra)


def judged_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, ...) as judged gives it, and __h, which tells rows of one id apart; the table that it writes holds no texts."""
    slim = with_lang(docs).select("doc_id", "text", "lang")
    with Scratch(docs.sparkSession) as space:
        words = space.written(common_words(slim))
        m = written(measured(slim.withColumn("__h", row_hash("text", "lang")), words).drop("text"))
    return verdicts(m)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. What the verdicts need holds no texts, and only the ids that fail are looked up."""
    failed = written(judged_counts(docs).where("not kept").select(F.col("doc_id").cast("long").alias("__id"), "__h").distinct())
    return listed(with_lang(docs), failed, "left_anti", "text", "lang").select(*docs.columns)

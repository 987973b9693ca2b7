"""One query for each operator of the subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed, jaccard, langid, lm, mixing, prefixtrie, quality, rules, sentencepieces, tokenalign, toxicity, warc
from .common import held_out, table, written


def tokenizer(name: str = sentencepieces.DEFAULT_MODEL) -> str:
    """The path of a public tokenizer file; a parameter of the encoder."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document: doc_id, n_chars, n_pieces, pieces_hash (xxhash64 of the ids), lossless (the pieces decode to the text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = sentencepieces.decode(sentencepieces.encode(docs, tokenizer(), F.col("doc_id")), tokenizer())
    text = F.coalesce("text", F.lit(""))
    return pieces.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), (F.col("decoded") == text).alias("lossless"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document: doc_id, n_words, pseudo_ll, mean_ll."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs)).drop("text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    mixed = mixing.with_targets(sizes, mixing.targets(sizes))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * mixing.copies(F.col("rate"), F.col("doc_id"))).alias("taken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judged_counts(docs).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.digests(chat.formatted(chat.canonical(chat.as_records(rows.unionByName(extra)), strict=True)))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", toxicity.held_back(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.aligned(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality_classifier, op3_jaccard_join, op4_lm_scoring, op5_mixing, op6_language_id, op7_warc, op8_embedding_dedup, op9_quality_rules, op10_chat_formatting, op11_toxicity, op12_prefix_trie, op13_token_alignment)}

"""The corpus pipeline: documents in, sampled token ids of a clean, deduplicated and weighted mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. No stage can be expressed in SQL as a whole (trained classifier, hashed sets,
sampled segmentations), so ORACLE_SQL is None; tests compare stages with brute-force versions.
An empty table gives an empty one in every stage. Columns beside those of documents pass through all stages but may not be named piece_ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxaloom.llm import jaccard, mixing, quality, rules, sentencepieces
from taxaloom.llm.common import row_hash, table, written
from taxaloom.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches 0.3. Labels are learned from those of the held-in rows. Null and empty texts are
    scored by their counts, all 0; repeated rows are scored alike; without labels of both kinds every document has one score."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and stay near their language's histograms. Null and empty texts fail; a null
    language is judged by the base rules alone; of rows with the same id, text and language all stay or none."""
    return rules.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component by 5-word shingles at a Jaccard similarity of 0.8 or more. Documents
    without words stay; rows with the same id and text count once; a null id comes last."""
    return jaccard.keep_one(docs, n=5, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins the documents of each source to its target share of words. A null source is one of its own; a source without words stays as it is."""
    source = written(mixing.targets(docs.select("source", mixing.words(F.col("text")).alias("size"))))
    return mixing.mix(docs, source)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and piece_ids, a sampled segmentation of the whole text. The sampling key is the id and the number
    of the copy, so copies that the mix repeats are cut in different ways. Null and empty texts have no pieces."""
    copy = Window.partitionBy("doc_id", row_hash()).orderBy("source", "lang", "n_chars")
    return sentencepieces.encode(docs.withColumn("__copy", F.row_number().over(copy)), tokenizer(), F.struct("doc_id", "__copy")).drop("text", "__copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("mixing_sources", mixing_sources),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

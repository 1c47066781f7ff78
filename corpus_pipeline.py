"""A corpus pipeline of five operators over ``documents``.

Each stage gets what its predecessor kept (written as Parquet and read again) and returns the columns of documents; the
last returns the mix.

Nulls: a null text has no language and goes in the first stage; a null doc_id, lang or source is kept like any other. An
empty text, or one without a letter, goes like a null one. Very long texts are judged whole. Ties: of a group of copies the
document with the smallest doc_id stays, of equal ids the one with the smaller text hash. Repeated rows are copies: one
stays. Empty tables: without documents there are no rows; without labels the classifier keeps all, without a benchmark
decontamination does. Further columns of documents, whatever their names, pass through all stages but the last untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontam, langid, mixing, quality, simhash
from larder.llm.common import broadcast_if_small, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language, or whose main language has less than half of the text."""
    find = langid.predictor(docs, langid.fit(docs))
    return docs.where(find("text")["score"] >= 0.5)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling towards good labelled text draws."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[1]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (five-word shingles, similarity of about 0.8 or more)."""
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = broadcast_if_small(saved(found.where("contaminated").select("doc_id", "hash").distinct(), "contaminated"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.xxhash64(docs["text"]) == hit["hash"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with the words taken (repeats counted)."""
    return mixing.mix_sources(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing_sources", mix),
]

#: Trained models, SimHash and seeded hashing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
``run`` writes each result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabflow.llm import langid, packing, quality_gam, simhash_dedup, suffix_dedup
from tabflow.llm.queries import held_out, sized, table
from tabflow.llm.shared import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier scores under 0.5."""
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    model = quality_gam.train(docs, labels)
    scored = quality_gam.quality_scores(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no known language: those that nothing was learned for, or too far from all."""
    prototypes = langid.train(docs.where(~held_out(5, 0)))
    predicted = langid.predict(docs, prototypes, keep=("text", "lang", "source", "n_chars"))
    kept = predicted.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.1))
    return kept.withColumnRenamed("id", "doc_id").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group (three-word shingles, two bits): that with
    the smallest id, nulls last, and of those the least hash of the text. A document is
    told by id and text, so null and repeated ids lose no other texts."""
    key = F.struct(
        F.col("doc_id").isNull().alias("last"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("th"),
    )
    keyed = docs.withColumn("key", key)
    found = simhash_dedup.simhash_components(keyed, id_col="key")
    first = found.where("id <=> component_id").select(F.col("id").alias("key"))
    # In a struct, null equals null; joined and made unique by it in one shuffle.
    kept = keyed.join(first.hint("merge"), "key", "left_semi")
    return kept.dropDuplicates(["key"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 200 bytes. Characters that a cut goes through go
    whole; a text of which nothing is left stays as an empty one."""
    cut = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    cut = cut.withColumnRenamed("id", "doc_id")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the words of each text, and an end, to training sequences."""
    return packing.pack(sized(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packed),
]

#: The classifier, the language profiles and the packing plan can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

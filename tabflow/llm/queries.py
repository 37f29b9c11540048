"""The registered queries of this subpackage, each its operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabflow.llm import (
    adaptive_rules, bpe, conversation_repair, embedding_dedup, langid, lexical_search, lm,
    merge_automaton, packing, quality_gam, simhash_dedup, suffix_dedup, warc,
)
from tabflow.llm.shared import crc_of_id

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(of: int, fold: int):
    """Whether a document's crc32 leaves that remainder; never for a null id."""
    return F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(of)) == fold, F.lit(False))


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.bpe_encode(table(spark, folder, "documents"), path, pattern)
    return bpe.bpe_decode(encoded, path).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn("held_out", held_out(5, 0))
    prototypes = langid.train(documents.where("NOT held_out"))
    predicted = langid.predict(documents, prototypes, keep=("held_out",))
    return predicted.withColumnRenamed("id", "doc_id")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.archive_pages(pages).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_dedup.embedding_components(table(spark, folder, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op6_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn("held_out", held_out(3, 1))
    labels = table(spark, folder, "labels").where(~held_out(3, 1))
    model = quality_gam.train(documents, labels)
    scored = quality_gam.quality_scores(documents, model, keep=("held_out",))
    return scored.withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.simhash_components(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op8_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = held_out(5, 1)
    scored = lm.score_texts(documents, ~out, path, pattern)
    scored = scored.withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths in words, and one for the end of each document, also of one without words."""
    return packing.pack(sized(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


def sized(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, adaptive_rules.SPACE), lambda w: w != ""))
    return documents.select("doc_id", (words + 1).alias("n_tokens"))


def op10_adaptive_rules(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = adaptive_rules.adaptive_quality(table(spark, folder, "documents"))
    return verdicts.withColumnRenamed("id", "doc_id")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with planted faults, repaired."""
    damaged = conversation_repair.damage(table(spark, folder, "conversations"))
    parts = conversation_repair.repair(damaged, copies_col="copies")
    return conversation_repair.digests(parts).withColumnRenamed("id", "conv_id")


def op12_merge_automaton(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    documents = table(spark, folder, "documents")
    return merge_automaton.automaton_encode(documents, path, pattern, decoded=True).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    found = lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_language_id, op3_suffix_dedup, op4_warc, op5_embedding_dedup,
        op6_quality_gam, op7_simhash, op8_attention_lm, op9_packing, op10_adaptive_rules,
        op11_conversation_repair, op12_merge_automaton, op13_lexical_search,
    )
}

SQL: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
    "op13_lexical_search": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
        a AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        p AS (SELECT doc_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT
            * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))) AS part
            FROM t JOIN d USING (doc_id) JOIN f USING (term), a),
        s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT
            AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 50""",
}

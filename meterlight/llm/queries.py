"""The registered queries of the operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm import bpe_words, centroids, conversations, decontamination, exact_dedup, langid, licenses, ngram_join, oracles, packing, quality_model, quality_rules, toxicity, url_filter
from meterlight.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.fit(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def _held_out(df: DataFrame, of: int, value: int) -> DataFrame:
    first, *rest = df.columns
    return df.select(first, F.coalesce(remainder("doc_id", of) == value, F.lit(False)).alias("held_out"), *rest)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(langid.identified(table(spark, sf_dir, "documents")), 4, 2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _held_out(toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 3, 1)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("licences")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations"))))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).withColumn("centroid", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).withColumnRenamed("centroid", "centroid_sha256")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_quality_classifier,
        op3_packing,
        op4_language_id,
        op5_exact_dedup,
        op6_quality_rules,
        op7_bpe,
        op8_toxicity,
        op9_url_filter,
        op10_license_scan,
        op11_conversation_repair,
        op12_centroid_clustering,
        op13_benchmark_decontamination,
    )
}
ORACLES: dict[str, str] = {
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op12_centroid_clustering": oracles.clustering(),
    "op13_benchmark_decontamination": oracles.DECONTAMINATION,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}

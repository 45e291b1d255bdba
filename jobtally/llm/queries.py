"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally.llm import bm25, bytebpe, centroids, classlm, hostpages, mixing, packing, private, quality, repeats, simhash, spelling, toxicity
from jobtally.llm.tables import documents, importable


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bytebpe.tokens(documents(spark, sf_dir), path, public_tokenizers.PATTERN, full=False)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def op5_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bm25.top_k(docs, docs.where("doc_id % 100 = 0"), k=10).withColumn("score", F.round("score", 6))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostpages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classlm.score(documents(spark, sf_dir))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = quality.judge(documents(spark, sf_dir))
    return verdict.select("doc_id", *quality.COUNTS, "base_failed", "kept", "removed_words")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return centroids.with_inertia(found)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_toxicity": op1_toxicity,
        "op2_pii": op2_pii,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_bm25_search": op5_bm25_search,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_class_lm": op8_class_lm,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_source_mixing": op13_source_mixing,
    }

    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return query(spark, sf_dir)

        return run

    return {name: ready(query) for name, query in found.items()}

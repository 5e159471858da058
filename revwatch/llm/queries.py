"""The operators applied to the given tables with production parameters, as registered queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    language,
    ngram_lm,
    packing,
    quality,
    simhash,
    spelling,
    token_counts,
    token_files,
    url_filters,
    whitening,
)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the folder may be named by ``TOKENIZER_DIR``."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.cut_documents(docs, vocabulary("byte_bpe_50k.json")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learnt(docs))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = ngram_lm.scores(docs, "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2")
    return rows.withColumn("held_out", language.held_out(F.col("doc_id"), 7, 2))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_files.read_token_files(spark.read.parquet(folder))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.length_histogram(token_counts.encoded_lengths(docs, vocabulary("byte_bpe_50k.json")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_best_fit_packing,
        op3_language_id,
        op4_benchmark_decontamination,
        op5_quality_classifier,
        op6_exact_dedup,
        op7_lm_scoring,
        op8_token_output,
        op9_simhash_near_dedup,
        op10_token_counts,
        op11_spelling_variants,
        op12_embedding_whitening,
        op13_ngram_jaccard_join,
    )
}

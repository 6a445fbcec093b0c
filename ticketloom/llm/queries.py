"""The registered queries of this package: each operator over its whole table, and the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, filter_audit, language_id, line_dedup, minhash_forest, packing, quality_compression
from . import quality_rules, secret_scan, token_counts, url_rules, whitening
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the contracts, where the public tokenizers are installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


@query
def op3_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents, "doc_id", "text", "lang")
    found = language_id.predict(documents, "doc_id", "text", model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


@query
def op4_url_filters(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), "page_id", "url")


@query
def op5_bpe_round_trip(spark, sf_dir):
    path = tokenizer_path()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    decoded = bpe.decode(encoded, "doc_id", "ids", path, keep=("ids",))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = quality_compression.train(documents, "doc_id", "text", table(spark, sf_dir, "labels"), "quality")
    scored = quality_compression.score(documents, "doc_id", "text", model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text", secret_scan.trained())


@query
def op8_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id", "text")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query
def op9_minhash_near_dedup(spark, sf_dir):
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=2, percent=80)


@query
def op10_line_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.deduplicate(documents, "doc_id", "text")
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query
def op11_token_counts(spark, sf_dir):
    path = tokenizer_path("byte_bpe_50k.json")
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def op13_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "labels"))

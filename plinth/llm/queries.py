"""The registered queries of this subpackage, one an operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import exact_dedup, fingerprints, language_id, line_dedup, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, source_divergence, substring_dedup, whitening
from plinth.llm.oracles import ORACLES  # noqa: F401  registered with the queries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="plinth demonstration key")
    total = F.aggregate("pii_counts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    kinds = F.array_join(F.transform("pii_counts", lambda x: F.concat_ws(":", x["kind"], x["n"].cast("string"))), ",")
    return out.select("doc_id", "text", total.alias("n_pii"), kinds.alias("kinds"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "quota_blocks")


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_spread_lines(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", F.sha2("cleaned_text", 256).alias("cleaned_sha256"))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_classifier.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.identify_language(docs.select("doc_id", "text"), language_id.fit_languages(docs))
    return out.select("doc_id", quality_classifier.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op13_lookup_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {f.__name__: f for f in (op1_pii_feistel, op2_source_mixing, op3_repeated_windows, op4_line_spread, op5_bounded_packing, op6_line_first_rules, op7_subword_quality, op8_language_hierarchy, op9_adaptive_prefix_join, op10_content_sort, op11_source_divergence, op12_embedding_whitening, op13_lookup_fingerprints)}

"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.llm import chat_windows, contextual_pii, golay_simhash, importance_resampling, language_id, license_join, mil_quality, quality_rules, sentencepiece_gumbel, separator_scan, sstable, suffix_decontam, whitening
from trivalent.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of this remainder are held out of language identification: crc32(doc_id) mod 5 = 0.
LANGUAGE_FOLD = (5, 0)


def language_profiles(docs: DataFrame):
    return language_id.train(docs, ~language_id.held_out("doc_id", *LANGUAGE_FOLD))


def op1_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_profiles(docs))
    return found.select("doc_id", language_id.held_out("doc_id", *LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score", "distance")


def op2_gumbel_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_gumbel.sample(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ids=False)
    each = [F.col(f"samples.{c}").alias(c) for c in ("n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion")]
    return found.select("doc_id", F.size("samples").cast("long").alias("n_samples"), *each, "round_trip")


def op3_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return sstable.read_shards(manifest, ids=False)


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=49407).select("doc_id", "n_tokens", "terminated")


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes("v2").alias("kept"), "n_lines", "n_upper", "n_exclaim", "n_digits", "failed",
    )


def quality_ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone too, from one ledger."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    each = [quality_rules.ablation(rows, p).withColumn("policy", F.lit(p)) for p in quality_rules.POLICIES]
    return each[0].unionByName(each[1]).unionByName(each[2])


#: Rows of this remainder are held out of the quality classifier: crc32(doc_id) mod 4 = 2.
QUALITY_FOLD = (4, 2)


def quality_model(docs: DataFrame, labels: DataFrame) -> mil_quality.Model:
    return mil_quality.train(docs, labels, ~language_id.held_out("doc_id", *QUALITY_FOLD))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mil_quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", language_id.held_out("doc_id", *QUALITY_FOLD).alias("held_out"), "score", F.when(F.col("score") >= mil_quality.KEEP_SCORE, 1).otherwise(0).alias("predicted"),
        "n_passages", "top_passage",
    )


def op7_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(suffix_decontam.CONTAMINATED).alias("contaminated"), "longest_words", "longest_at",
    )


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_join.license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        "score", F.size("matches").cast("long").alias("n_matches"),
    )


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", golay_simhash.as_hex("print").alias("fingerprint"), "component_id", "n_links")


#: The conversation that the contract adds: control strings inside its texts.
ADDED = "\\### Assistant: </turn> ok"


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], turns.schema)
    return chat_windows.digests(chat_windows.format_windows(turns.unionByName(added)))


def op11_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextual_pii.digests(contextual_pii.find(table(spark, sf_dir, "documents")))


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_rank_order_language": op1_rank_order_language,
    "op2_gumbel_sentencepiece": op2_gumbel_sentencepiece,
    "op3_sstable_shards": op3_sstable_shards,
    "op4_quality_ledger": op4_quality_ledger,
    "op5_separator_scan": op5_separator_scan,
    "op6_attention_quality": op6_attention_quality,
    "op7_suffix_decontam": op7_suffix_decontam,
    "op8_license_join": op8_license_join,
    "op9_simhash_golay": op9_simhash_golay,
    "op10_chat_windows": op10_chat_windows,
    "op11_contextual_pii": op11_contextual_pii,
    "op12_tiled_whitening": op12_tiled_whitening,
    "op13_trie_resampling": op13_trie_resampling,
    "quality_ledger_ablation": quality_ledger_ablation,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_ledger": quality_rules.SQL,
    "quality_ledger_ablation": quality_rules.ABLATION_SQL,
    "op7_suffix_decontam": suffix_decontam.SQL,
    "op8_license_join": license_join.sql(),
    "op10_chat_windows": chat_windows.SQL,
    "op13_trie_resampling": importance_resampling.SQL,
}

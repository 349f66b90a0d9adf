"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_main, langid, lm_score, neardup, oracles, pieces, prefix_trie, quality_pu, quality_rules, secret_scan
from .packing import pack
from .tokens import count_tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, 1024, 2, with_ids=False)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.default_samples(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), model)
    base = F.col("base")
    return found.select(
        "doc_id",
        *(secret_scan.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, 1024)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return lm_score.score(table(spark, sf_dir, "documents"), fold != 2, fold == 5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit, item_ids = decontaminate.covered(F.col("matches")), decontaminate.items(F.col("matches"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(item_ids, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_pu.train(docs, labels, _fold(3) != 1)
    scored = quality_pu.score(docs, model)
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, _fold(5) != 0))
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECES, begin=True, end=True)
    return pieces.decode(encoded, PIECES).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"), group=20, heads=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # the script at the top imports this subpackage, so not before it is asked for

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": oracles.DECONTAMINATION,
    "op9_near_dedup": oracles.NEAR_DEDUP,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}

"""The queries op1 to op13, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, extraction, mixing, negatives, packing, quality, resampling, sharding, simhash, substring, tokencount, tokenfile, toxicity
from lodestone.llm.oracles import ORACLES
from lodestone.session import shared_dir, table

BPE = "byte_bpe_50k.json"
TREE, GROWN = sharding.Tree.of(8), sharding.Tree.of(9)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), TREE, GROWN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), end_id=1, ids=False)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-file")
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BPE), end_id=2)
    return tokenfile.read(spark, path, ids=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.kept(quality.BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.kept(quality.POLICIES[-1]).alias("kept"), "failed")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def queries() -> dict:
    found = (op1_shard, op2_token_counts, op3_simhash, op4_substring_dedup, op5_html, op6_toxicity, op7_decontaminate, op8_packing, op9_token_file, op10_quality, op11_hard_negatives, op12_mixing, op13_resampling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in queries()}

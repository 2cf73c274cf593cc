"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path as tokenizer_path

from shelfwise.llm import (cnn, decontam, langid, line_dedup, ngram_trie, packing, prefix_trie, repetition, sharding,
                           simhash, spelling, urls, wavelet)
from shelfwise.llm.common import documents
from shelfwise.session import ensure_checkpoint_dir

TOKENIZER = tokenizer_path("byte_bpe_50k.json")
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER, capacity=1024, end_id=2)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), modulus=5)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cnn.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=5)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(documents(spark, sf_dir), TOKENIZER, end_id=0)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.learn_and_score(documents(spark, sf_dir), modulus=10, order=3)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf_dir))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_sharding,
                                   op4_benchmark_decontamination, op5_language_id, op6_repetition_rules,
                                   op7_quality_classifier, op8_url_filters, op9_token_files,
                                   op10_lm_scoring, op11_conversation_trie, op12_line_dedup, op13_spelling_groups)}
ORACLE = {
    "op3_sharding": sharding.sharding_sql(SHARDS, sharding.table_size(len(SHARDS))),
    "op4_benchmark_decontamination": decontam.contaminated_sql(),
    "op6_repetition_rules": repetition.repetition_sql(),
    "op11_conversation_trie": prefix_trie.conversation_trie_sql(),
    "op12_line_dedup": line_dedup.line_digests_sql(),
    "op13_spelling_groups": spelling.spelling_sql(),
}

"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe_sql, crf, html_text, packing, periodic, pii, prefix_trie, quality, simhash, substrings, urls, wavelet
from .common import load


def op1_wavelet_matrix(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    out = wavelet.encode_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(load(spark, folder, "pages"))


def op3_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(load(spark, folder, "pages")).drop("template")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    return bpe_sql.encode_decode_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(load(spark, folder, "embeddings"))


def op6_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(load(spark, folder, "documents"), digest=True)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, folder, "documents"))
    return out.select("doc_id", simhash.hex_digits(out["fp"]).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(load(spark, folder, "documents"), load(spark, folder, "labels")).drop("text")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    spans, _ = pii.find(load(spark, folder, "documents"))
    return pii.digest(spans)


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    return packing.pack(packing.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op11_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    return crf.identify(load(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.find(load(spark, folder, "documents"), digest=True, prepare=periodic.repeat_a_tail))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.build_grafted(load(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_matrix": op1_wavelet_matrix,
    "op2_main_text": op2_main_text,
    "op3_url_templates": op3_url_templates,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_suffix_arrays": op6_suffix_arrays,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_personal_data": op9_personal_data,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_language_crf": op11_language_crf,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op3_url_templates": urls.judge_sql(), "op13_prefix_trie": prefix_trie.build_grafted_sql()}

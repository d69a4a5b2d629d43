"""The registered queries: each applies one operator, with production
parameters, to its whole table, and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.llm import (exact_topk, fuzzy_lines, infill, mixing, packing, permutation_index, reply_trees, sanitize,
                          setsketch, spelling, suffix_repeats, toxicity, wavelet)
from shiplens.llm.common import new_table_path, saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_topk.whole_numbers(_table(spark, sf_dir, "embeddings"))
    return exact_topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score_documents(docs, model))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = reply_trees.linear_turns(table.unionByName(reply_trees.control_conversation(spark)))
    return reply_trees.digest(reply_trees.format_conversations(saved(turns, "turns")))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "wavelet")
    wavelet.write_token_files(_table(spark, sf_dir, "documents"), path)
    return wavelet.read_token_files(spark, path, with_ids=False)


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.digest(_table(spark, sf_dir, "documents"))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", F.array("source").alias("sources"), mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.digest(sanitize.find_personal_data(_table(spark, sf_dir, "documents")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_exact_topk, op3_toxicity, op4_reply_trees, op5_wavelet, op6_setsketch,
    op7_fuzzy_lines, op8_permutation_index, op9_mixing, op10_sanitize, op11_infill, op12_spelling,
    op13_suffix_repeats)}

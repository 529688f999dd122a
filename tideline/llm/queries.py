"""Registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tideline.llm import automata, chats, decontaminate, fmquality, languages, linefreq, mixing, negatives, periods, secretscan, simhash, suffixes, warc
from tideline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return linefreq.document_rules(read_table(spark, folder, "documents")).drop("row_key")


@query
def op1_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, folder, "pages"))


@query
def op6_source_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(read_table(spark, folder, "documents"))


@query
def op8_snapshot_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return chats.rendered(read_table(spark, folder, "conversations"))


@query
def op2_factorisation_quality(spark: SparkSession, folder: str) -> DataFrame:
    return fmquality.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op7_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.item_matches(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op10_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.document_components(read_table(spark, folder, "documents"))


@query
def op9_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.secret_findings(read_table(spark, folder, "documents"), path_column="source")


@query
def op3_phrase_automata(spark: SparkSession, folder: str) -> DataFrame:
    return automata.without_passages(read_table(spark, folder, "documents"))


@query
def op5_prefix_doubling(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.without_repeats(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_tree_bound_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, folder, "embeddings"))


@query
def op12_diagonal_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.periodic_runs(read_table(spark, folder, "documents"), planted=True).drop("n_words", "runs")


@query
def op13_piece_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.document_languages(read_table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run

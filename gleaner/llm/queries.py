"""Queries that apply the operators to the whole given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import (alignment, classifier, codes, jaccard, mixing, neighbours, packing, page_text, quality_rules, substring,
                         suffix_array, tool_calls, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_tool_calls(spark, sf_dir):
    calls, results = tool_calls.calls_of_conversations(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_all(calls, results, tool_calls.schema_table(spark, tool_calls.TOOLS))
    return linked.withColumnsRenamed({"conv": "conv_id", "call": "call_id"})


@query
def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("k1", "k2")


@query
def op5_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


@query
def op6_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("k1", "k2")


@query
def op7_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


@query
def op8_nearest(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_classifier(spark, sf_dir):
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffix_array.suffix_dedup(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query
def op12_page_text(spark, sf_dir):
    return page_text.main_text(table(spark, sf_dir, "pages"))


@query
def op13_token_alignment(spark, sf_dir):
    return alignment.token_alignment(table(spark, sf_dir, "documents"))

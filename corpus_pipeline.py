"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing, token ids; a table after each stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.bpe import bpe_encode
from flowloom.llm.common import stage, table
from flowloom.llm.fertility import keep_good
from flowloom.llm.mixing import emit, mix
from flowloom.llm.simhash import one_of_each
from flowloom.llm.suffix_dedup import PASSAGE, without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their language's fertility band rejects go."""
    return keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes (so, passages of over 50 words) that start elsewhere too are taken out of the texts; the documents stay."""
    return without_repeats(docs, PASSAGE)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return emit(mix(docs), docs.columns)


def bpe_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32) and their digest."""
    got = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_token_ids", bpe_token_ids),
]

#: No stage but the mixing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

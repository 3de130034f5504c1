"""The corpus pipeline: documents to packed windows in five stages.

A stage's scratch tables last until the next stage is called, so its result must be written by then;
``run`` does so, and has scratch tables of its own for each call.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. A row
that a stage does not reject reaches the next one, with its nulls and extra values as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, minhash, packing, quality, suffix_dedup
from weftline.scratch import materialize, sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The name under which the scratch tables of the stages are kept; every ``run`` has another.
_TAG: ContextVar[str] = ContextVar("scratch tables", default="pipeline")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    sweep(spark, _TAG.get())
    judged = quality.judge(docs, carry=("text", "lang", "source", "n_chars"), tag=_TAG.get())
    return judged.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id, unchanged."""
    sweep(spark, _TAG.get())
    return minhash.keep_one(docs.select(*COLUMNS), tag=_TAG.get())


def exact_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings; a character that loses a byte goes whole. n_chars follows the text."""
    sweep(spark, _TAG.get())
    cut = suffix_dedup.remove_repeats(docs, carry=("text", "lang", "source", "n_chars"), whole_characters=True, tag=_TAG.get())
    changed = F.col("n_removed") > 0
    cut = cut.withColumn("text", F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks, unchanged."""
    sweep(spark, _TAG.get())
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a packed piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    sweep(spark, _TAG.get())
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tag=_TAG.get())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("repeated strings", exact_spans),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", pack),
]

#: Signatures, token ids and latent spaces are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tag = f"pipeline {uuid.uuid4().hex}"
    before = _TAG.set(tag)
    try:
        for i, (name, stage) in enumerate(STAGES[:-1]):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), f"{tag} {i}")
            # What the stage has read is not needed any more.
            sweep(spark, f"{tag} {i - 1}")
        packed = materialize(STAGES[-1][1](spark, docs, sf_dir), "packed", f"{tag} packed")
        sweep(spark, tag)
        sweep(spark, f"{tag} {len(STAGES) - 2}")
        return packed
    finally:
        _TAG.reset(before)

"""The thin registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, decontaminate, language_id, lm_score, minhash, packing, quality, suffix_dedup, token_counts, url_filter
from weftline.scratch import new_path

WINDOW = 4096
END_ID = 2


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where the files have fewer splits than there are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 4096 ids."""
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), WINDOW, END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    injected = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(injected, turns.schema))
    return chat_format.read_back(chat_format.format_chats(turns))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, through a cache that begins empty."""
    counts = token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > WINDOW)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document."""
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _remainder(modulus: int, value: int) -> Column:
    """Whether crc32 of the document id as text leaves this remainder; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == value


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.identify(_documents(spark, sf_dir), _remainder(3, 1), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and model score of every document."""
    return lm_score.score(_documents(spark, sf_dir), _remainder(10, 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated 100-byte strings."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(_documents(spark, sf_dir)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicates(_documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat_format": op2_chat_format,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash": op10_minhash,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat_format.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_minhash": minhash.ORACLE,
}

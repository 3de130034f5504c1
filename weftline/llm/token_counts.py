"""Exact token counts behind a digest cache.

The cache is a Parquet folder of (tokenizer digest, content digest) -> count. A run digests
every text, keeps one text a digest, drops those whose digest the cache holds for this
tokenizer, encodes the rest once, appends their counts and joins all rows to the cache.

Defined cases: a null text is an empty one; repeated texts are encoded once; the rows of an
empty table are none. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columnar import encode_words, keep_arenas, plain_strings, slices, split_words

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"

#: Only the blank separates chunks here: other white space yields tokens.
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True

_LOADED: dict[str, PieceCounter] = {}


def tokenizer_digest(path: str) -> str:
    """Identifies the vocabulary file and the library that reads it."""
    import sentencepiece

    return hashlib.sha256(Path(path).read_bytes() + f"|sentencepiece {sentencepiece.__version__}".encode()).hexdigest()


class PieceCounter:
    """Counts as ``SentencePieceProcessor.encode`` gives them.

    No piece of a vocabulary may hold the blank mark after another character; then merges never
    cross a single blank, and a text's count is the sum over its blank-separated chunks, each
    encoded once a batch. Texts with runs of blanks, outer blanks or the mark itself are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.additive = not any("▁" in x.lstrip("▁") for x in names)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "▁"))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        alone = odd.to_numpy(zero_copy_only=False) if self.additive else np.ones(len(texts), bool)
        out = np.zeros(len(texts), np.int64)
        if (~alone).any():
            words, bounds = split_words(texts.filter(pa.array(~alone)), spaces=_BLANK)
            codes, distinct = encode_words(words)
            each = np.array(self.whole(distinct.to_pylist()), np.int64)
            sums = np.concatenate([[0], np.cumsum(each[codes])]) if len(codes) else np.zeros(1, np.int64)
            out[~alone] = sums[bounds[1:]] - sums[bounds[:-1]]
        if alone.any():
            out[alone] = self.whole(texts.filter(pa.array(alone)).to_pylist())
        return out


def piece_counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """One row a (tokenizer, digest), also where two runs appended the same text; empty if there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens. Appends to the cache at ``cache_path`` what it lacks."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        counter = piece_counter(tokenizer_path)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(version, batch.num_rows), batch.column(0), pa.array(counter.counts(plain_strings(batch.column(1))))],
                names=["tokenizer", "digest", "n_tokens"],
            )

    # Repeated texts meet in the map tasks first, so a hot text sends one row a task.
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(count, CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache_path)
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(stored, "digest", "left").select("doc_id", "n_bytes", "n_tokens")

"""A stream of descriptors, quantized and counted as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pictora.operators.assign import assign
from pictora.operators.bow import term_counts


def word_counts(stream: DataFrame, vocabulary: DataFrame, metric: str = "cosine") -> DataFrame:
    """Running ``(image_id, word_id, tf)`` of a stream of ``(image_id, descriptor)``; the batch operators unchanged."""
    return term_counts(assign(stream.select("image_id", "descriptor"), vocabulary, metric))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("image_id string, descriptor array<double>").parquet(path)


def write_words(stream: DataFrame, vocabulary: DataFrame, path: str, checkpoint: str, metric: str = "cosine") -> StreamingQuery:
    """Append each descriptor's word to a Parquet folder, exactly once, until what is there is done."""
    words = assign(stream, vocabulary, metric).select("image_id", F.col("word_id"))
    return words.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

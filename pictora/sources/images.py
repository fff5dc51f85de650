"""Folders of images: listing, packing and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictora.functions import paths

#: Extensions taken for images, and the largest file that is read.
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp")
LARGEST = 40 * 1024 * 1024


def scan(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """``(image_key, content)`` of the images below ``root``: names without white space, not empty, at most ``largest`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = paths.name(F.col("path"))
    fits = named.rlike(rf"(?i)^\S+\.({'|'.join(EXTENSIONS)})$") & F.col("length").between(1, largest)
    return files.where(fits).select(paths.image_key("path").alias("image_key"), "content")


def pack(images: DataFrame, path: str) -> None:
    images.write.mode("overwrite").parquet(path)


def unpack(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Packed images; with ``folder`` in front of each key."""
    images = spark.read.parquet(path).where(F.length("content") > 0)
    return images if folder is None else images.withColumn("image_key", F.concat_ws("/", F.lit(folder), "image_key"))


def pack_sequence(images: DataFrame, path: str) -> None:
    """For tools that read Hadoop sequence files: key and bytes."""
    images.select("image_key", "content").rdd.map(lambda r: (r.image_key, bytearray(r.content))).saveAsSequenceFile(path)


def unpack_sequence(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.sparkContext.sequenceFile(path, "org.apache.hadoop.io.Text", "org.apache.hadoop.io.BytesWritable")
    return spark.createDataFrame(rows.map(lambda x: (x[0], bytes(x[1]))), "image_key string, content binary")


def decode(spark: SparkSession, root: str) -> DataFrame:
    """``(image_key, height, width, n_channels, data)`` of what the JVM can decode below ``root``; other files are dropped."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(root)
    return found.select(paths.image_key("image.origin").alias("image_key"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")

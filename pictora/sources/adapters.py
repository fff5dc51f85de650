"""The engine's inputs, taken from the plain tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A keyword for each category.
KEYWORDS = ("the", "and", "of", "in", "to", "on", "la", "der", "de", "que")
IMAGES_PER_CATEGORY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, image_id, category, image_no, descriptor)``: several descriptors of each image."""
    number = F.col("label") * IMAGES_PER_CATEGORY + F.col("vec_id") % IMAGES_PER_CATEGORY
    category = F.concat(F.lit("c"), F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", category.alias("category"), number.cast("long").alias("image_no"), F.col("embedding").cast("array<double>").alias("descriptor"))
    return rows.select("vec_id", F.format_string("images/%s/%d.jpg", "category", "image_no").alias("image_id"), "category", "image_no", "descriptor")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_no, caption)``: the document with an image's number is its caption."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_no"), F.col("text").alias("caption"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_no, relevant)``; images that nobody annotated have no row."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_no"), F.col("quality").alias("relevant"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_img, category, keyword)``: the first image of each category."""
    keyword = F.element_at(F.array(*map(F.lit, KEYWORDS)), F.substring("category", 2, 9).cast("int") + 1)
    images = features(spark, sf_dir).where(F.col("image_no") % IMAGES_PER_CATEGORY == 0).select("image_id", "category").distinct()
    return images.select(F.col("image_id").alias("query_img"), "category", keyword.alias("keyword"))


def drawn_images(spark: SparkSession, sf_dir: str, cell: int = 8) -> DataFrame:
    """Decoded images ``(image_key, height, width, n_channels, data)``: each image's first descriptor as squares of gray."""
    rows = features(spark, sf_dir).groupBy("image_id").agg(F.min_by("descriptor", "vec_id").alias("d"))
    scaled = F.transform("d", lambda x: F.lpad(F.hex(F.round((x - F.array_min("d")) / (F.array_max("d") - F.array_min("d")) * 255).cast("long")), 2, "0"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.transform(F.slice("shade", y * 8 + 1, 8), lambda h: F.repeat(h, F.lit(cell))), ""), F.lit(cell)))
    drawn = rows.select("image_id", scaled.alias("shade")).select("image_id", F.unhex(F.array_join(lines, "")).alias("data"))
    return drawn.select(F.col("image_id").alias("image_key"), F.lit(8 * cell).alias("height"), F.lit(8 * cell).alias("width"), F.lit(1).alias("n_channels"), "data")

"""The text layouts that tools around the engine exchange, read into typed columns and written from them."""

from __future__ import annotations

from collections.abc import Mapping
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictora.functions import paths


def descriptor(line: Column | str, geometry: int = 4) -> Column:
    """The values of a descriptor line behind its scale, orientation and place."""
    values = F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"\s+")
    return F.transform(F.slice(values, geometry + 1, F.greatest(F.size(values) - geometry, F.lit(0))), lambda x: x.cast("double"))


def _words(dim: int) -> list[Column]:
    body = F.regexp_extract("value", r"\{(.*?)\}", 1)
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x))
    sparse = F.map_from_entries(F.transform(parts, lambda p: F.struct(F.split(p, ":").getItem(0).cast("int"), F.split(p, ":").getItem(1).cast("double"))))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(sparse, i), F.lit(0.0)))
    center = F.when(body.contains(":"), filled).when(F.trim(body) == "", F.array_repeat(F.lit(0.0), dim)).otherwise(F.transform(parts, lambda x: x.try_cast("double")))
    return [F.trim(F.substring_index("value", "\t", 1)).cast("int").alias("word_id"), center.alias("center")]


def read_vocabulary(spark: SparkSession, path: str | list[str], dim: int) -> DataFrame:
    """``(word_id, center)`` from lines ``id TAB {v0,v1,...}`` or ``id TAB {i:v,...}`` of one or several paths; values left out are zero."""
    return spark.read.text(path).where(F.trim("value") != "").select(*_words(dim))


def _line(word: str) -> Column:
    values = F.array_join(F.transform("center", lambda x: x.cast("string")), ",")
    return F.concat_ws("\t", F.col(word).cast("string"), F.concat(F.lit("{"), values, F.lit("}")))


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select(_line("word_id")).write.mode("overwrite").text(path)


def write_levels(top: DataFrame, bottom: DataFrame, path: str) -> None:
    """Both levels of a vocabulary as text, in the folders ``level=0/top_id=-1`` and ``level=1/top_id=<id>``."""
    upper = top.select(_line("top_id").alias("value"), F.lit(0).alias("level"), F.lit(-1).alias("top_id"))
    lower = bottom.select(_line("bot_id").alias("value"), F.lit(1).alias("level"), F.col("top_id").cast("int").alias("top_id"))
    upper.unionByName(lower).repartition("level", "top_id").write.mode("overwrite").partitionBy("level", "top_id").text(path)


def read_levels(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(top_id, center)`` and ``(top_id, bot_id, center)`` of what ``write_levels`` wrote."""
    top = read_vocabulary(spark, f"{path}/level=0/top_id=-1", dim).withColumnRenamed("word_id", "top_id")
    of = F.regexp_extract(F.col("_metadata.file_path"), r"top_id=(-?\d+)", 1).cast("int")
    lines = spark.read.text(f"{path}/level=1/*").select("value", of.alias("top_id"))
    return top, lines.select("top_id", *_words(dim)).withColumnRenamed("word_id", "bot_id")


def write_by_cluster(assigned: DataFrame, path: str) -> None:
    """Descriptors in a folder ``top_id=<id>`` for each top cluster; a cluster that holds most of them is written by many tasks."""
    assigned.hint("rebalance", "top_id").write.mode("overwrite").partitionBy("top_id").parquet(path)


def checked_vocabulary(vocabulary: DataFrame, k: int) -> DataFrame:
    """The vocabulary, if it has the words 0 to k-1 once each; else an error that says what is wrong."""
    seen = vocabulary.agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("ids"), F.min("word_id").alias("low"), F.max("word_id").alias("high")).first()
    if (seen.n, seen.ids, seen.low, seen.high) != (k, k, 0, k - 1):
        raise ValueError(f"{k} words wanted, found {seen.n} rows with {seen.ids} ids from {seen.low} to {seen.high}")
    return vocabulary


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id, total, words)`` from lines ``image TAB n TAB w w w``."""
    cells = F.split("value", "\t")
    words = F.transform(F.filter(F.split(cells.getItem(2), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return spark.read.text(path).where(F.trim("value") != "").select(cells.getItem(0).alias("image_id"), cells.getItem(1).cast("long").alias("total"), words.alias("words"))


def write_histograms(histograms: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "image_id", F.col("total").cast("string"), F.array_join(F.transform("words", lambda x: x.cast("string")), " "))
    histograms.select(line).write.mode("overwrite").text(path)


def write_terms(docs: DataFrame, path: str) -> None:
    """``image TAB n TAB terms`` from ``(image_id, n, terms)``."""
    docs.select(F.concat_ws("\t", "image_id", F.col("n").cast("string"), F.array_join("terms", " "))).write.mode("overwrite").text(path)


def read_index_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, terms)`` from the first and third column of tabbed lines."""
    cells = F.split("value", "\t")
    return spark.read.text(path).select(cells.getItem(0).alias("doc_id"), F.filter(F.split(F.get(cells, F.lit(2)), r"\s+"), lambda x: x != "").alias("terms"))


def read_captions(spark: SparkSession, pattern: str) -> DataFrame:
    """``(category, file, caption)`` from lines ``file --- text --- text`` in files that lie one in each category's folder; of a repeated key the last line counts."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    named = lines.select(paths.folder("path").alias("category"), F.trim(F.substring_index("value", "---", 1)).alias("file"), paths.first_segment("value").alias("caption"), "line").where("caption is not null")
    key = paths.stem("file")
    return named.groupBy("category", key.alias("stem")).agg(F.max_by("file", "line").alias("file"), F.max_by("caption", "line").alias("caption")).select("category", "file", "caption")


def read_captions_by_number(spark: SparkSession, pattern: str) -> DataFrame:
    """``(doc_id, text)``: captions of files named by a number and an extension of three letters."""
    file = F.trim(F.substring_index("value", "---", 1))
    number = F.substring(file, F.lit(1), F.length(file) - 4).try_cast("long")
    return spark.read.text(pattern).select(number.alias("doc_id"), paths.first_segment("value").alias("text")).where("doc_id is not null")


def read_queries(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``(category, keyword, query_img)``.

    Without a separator a line is ``category img img ...`` and the category is the keyword; with ``---`` it is
    ``keyword---category---img img ...``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if separator is None:
        cells = F.split(F.trim("value"), r"\s+")
        return lines.select(cells.getItem(0).alias("category"), cells.getItem(0).alias("keyword"), F.explode(F.slice(cells, 2, F.size(cells) - 1)).alias("query_img"))
    cells = F.split("value", separator)
    images = F.filter(F.split(cells.getItem(2), r"\s+"), lambda x: x != "")
    return lines.select(F.trim(cells.getItem(1)).alias("category"), F.trim(cells.getItem(0)).alias("keyword"), F.explode(images).alias("query_img"))


def write_rankings(ranked: DataFrame, path: str) -> None:
    """``(query_img, modality, rank, doc_id, ...)``, a folder for each modality."""
    ranked.write.mode("overwrite").partitionBy("modality").parquet(path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``(relevant, rank, doc_id, text)`` from lines ``relevant TAB rank TAB id TAB text``; an empty first column is not annotated, anything but 0 and 1 an error."""
    cells = F.split("value", "\t", 4)
    mark = F.trim(cells.getItem(0))
    relevant = F.when(mark.isin("0", "1"), mark.cast("int")).when(mark == "", None).otherwise(F.raise_error(F.concat(F.lit("not an annotation: "), "value")).cast("int"))
    return spark.read.text(path).where(F.trim("value") != "").select(relevant.alias("relevant"), cells.getItem(1).cast("int").alias("rank"), cells.getItem(2).cast("long").alias("doc_id"), cells.getItem(3).alias("text"))


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """One tabbed file, in order."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def config_to_xml(values: Mapping[str, object]) -> str:
    """A settings file: the values are the root's attributes."""
    return ElementTree.tostring(ElementTree.Element("conf", {k: str(v) for k, v in values.items()}), "unicode")


def config_from_xml(text: str) -> dict[str, str]:
    return dict(ElementTree.fromstring(text).attrib)


def write_config(spark: SparkSession, values: Mapping[str, object], path: str) -> None:
    spark.createDataFrame([(config_to_xml(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    return config_from_xml("\n".join(r.value for r in spark.read.text(path).collect()))

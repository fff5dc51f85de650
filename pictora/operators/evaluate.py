"""Quality of rankings: average precision, its mean, and the accuracy of annotated tops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictora.functions import paths


def flagged(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``relevant``: 1 if the document lies in the query's category."""
    return ranked.withColumn("relevant", paths.relevance("doc_id", "category"))


def precision_at(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``precision``: the share of relevant documents up to each rank."""
    order = Window.partitionBy("modality", "query_img").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return flagged(ranked).withColumn("precision", F.sum("relevant").over(order) / (F.col("rank") + 1))


def average_precision(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``(modality, query_img, category, ap)``; ``relevant`` is ``(category, n)``, all relevant documents whether found or not."""
    hits = precision_at(ranked).groupBy("modality", "query_img", "category").agg(F.sum(F.col("precision") * F.col("relevant")).alias("hits"))
    rows = hits.join(relevant, "category", "left")
    return rows.select("modality", "query_img", "category", F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame, *by: str) -> DataFrame:
    """The mean over the queries that were evaluated."""
    return ap.groupBy(*(by or ("modality",))).agg(F.avg("ap").alias("mean_ap"), F.count("*").alias("n_queries"))


def accuracy(annotated: DataFrame) -> DataFrame:
    """``(modality, query_img, accuracy, n_annotated)`` over the rows somebody annotated (``relevant`` not null)."""
    known = annotated.where("relevant is not null")
    return known.groupBy("modality", "query_img").agg(F.avg("relevant").alias("accuracy"), F.count("*").alias("n_annotated"))


def accuracy_summary(rows: DataFrame, modalities: tuple[str, ...]) -> DataFrame:
    """One row: the mean accuracy of each modality."""
    return rows.agg(*[F.avg(F.when(F.col("modality") == m, F.col("accuracy"))).alias(m) for m in modalities])


def share_equal(found: Column | str, exact: Column | str) -> Column:
    """Aggregate: the share of queries whose approximate neighbour is the exact one."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.avg((col(found) == col(exact)).cast("int"))

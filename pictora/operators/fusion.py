"""Late fusion of two rankings by weighted ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weight(ap: DataFrame, first: str = "tw", second: str = "vw", multiplier: float = 1.0) -> DataFrame:
    """``(query_img, lambda)``: the first modality's share of both average precisions, times a multiplier; 0.5 if both are zero.

    With a multiplier over one it may exceed one.
    """
    rows = ap.groupBy("query_img").agg(*[F.max(F.when(F.col("modality") == m, F.col("ap"))).alias(f"ap_{m}") for m in (first, second)]).where(f"ap_{first} is not null and ap_{second} is not null")
    total = F.col(f"ap_{first}") + F.col(f"ap_{second}")
    return rows.select("query_img", F.coalesce(F.lit(multiplier) * F.try_divide(F.col(f"ap_{first}"), total), F.lit(0.5)).alias("lambda"))


def fuse(ranked: DataFrame, weights: DataFrame, first: str = "tw", second: str = "vw", top: int | None = None) -> DataFrame:
    """``(query_img, category, doc_id, fused, rank)``: ``lambda * rank in first + (1 - lambda) * rank in second``, least first.

    A document that one ranking lacks has the length of the longer ranking there. Both rankings of a query meet in one
    aggregation, which also serves as the full outer join.
    """
    rows = ranked.where(F.col("modality").isin(first, second))
    rank_of = lambda m: F.min(F.when(F.col("modality") == m, F.col("rank")))
    both = rows.groupBy("query_img", "category", "doc_id").agg(rank_of(first).alias("a"), rank_of(second).alias("b"))
    length = rows.groupBy("query_img", "modality").agg(F.count("*").alias("n")).groupBy("query_img").agg(F.max("n").alias("missing"))
    rows = both.join(length, "query_img").join(weights, "query_img")
    fused = F.col("lambda") * F.coalesce("a", "missing") + (1 - F.col("lambda")) * F.coalesce("b", "missing")
    rows = rows.select("query_img", "category", "doc_id", fused.alias("fused"))
    order = Window.partitionBy("query_img").orderBy(F.round("fused", 9), "doc_id")
    placed = rows.withColumn("place", F.row_number().over(order))
    placed = placed if top is None else placed.where(F.col("place") <= top)
    return placed.withColumn("rank", F.col("place") - 1).drop("place")

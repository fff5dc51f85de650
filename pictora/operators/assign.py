"""Nearest visual word of each descriptor: exact, hierarchical, or approximate.

A vocabulary is ``(word_id, center)``. It goes to the executors in blocks of a bounded size, one after the other, each
pass keeping the better of the block's winner and the winner so far, so no vocabulary is too large to be sent and no descriptor is
shuffled. Ties go to the lower word; a descriptor of length zero has no cosine and gets word -1, as does any descriptor
where the vocabulary is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictora.functions import vectors
from pictora.operators.forest import Forest

#: Values of a block of centers: 64 MB.
BLOCK_VALUES = 8_000_000
ROWS = 4096
#: Scores that stand in memory at a time: 16 MB, whatever the number of words.
TILE = 2_000_000


#: Words in order and their centers.
Matrix = tuple[np.ndarray, np.ndarray]


def matrix(vocabulary: DataFrame | Matrix) -> Matrix:
    """A vocabulary in the driver's memory; it is bounded by its number of words, a parameter of its making."""
    if isinstance(vocabulary, tuple):
        return vocabulary
    rows = vocabulary.select("word_id", "center").orderBy("word_id").collect()
    return np.array([r.word_id for r in rows], np.int64), np.array([r.center for r in rows], float).reshape(len(rows), -1 if rows else 0)


def scores(x: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """What is largest for the nearest center: cosine, or minus the squared distance."""
    if metric == "euclidean":
        return -((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (x @ centers.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((centers * centers).sum(1)))
    return np.where(np.isnan(out), -np.inf, out)


def best_of(x: np.ndarray, centers: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of its best centers and that one's score, tile by tile."""
    at, top = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    step = max(1, TILE // max(1, len(x)))
    for low in range(0, len(centers), step):
        value = scores(x, centers[low : low + step], metric)
        found = value.argmax(axis=1)
        value = value[np.arange(len(x)), found]
        better = value > top
        at, top = np.where(better, low + found, at), np.where(better, value, top)
    return at, top


def dense(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def _with_word(batches: Iterator[pa.RecordBatch], at: int, name: str, words_of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield words_of(part, dense(part.column(at)))


def assign(features: DataFrame, vocabulary: DataFrame | Matrix, metric: str = "cosine", to: str = "word_id", column: str = "descriptor") -> DataFrame:
    """``features`` with the nearest word, by matrix products on Arrow batches."""
    words, centers = matrix(vocabulary)
    step = max(1, BLOCK_VALUES // max(1, centers.shape[1])) if len(words) else 1
    at, spark = features.columns.index(column), features.sparkSession
    out = features.withColumns({to: F.lit(-1).cast("int"), "__score": F.lit(float("-inf"))})
    for low in range(0, len(words), step):
        shared = spark.sparkContext.broadcast((words[low : low + step], centers[low : low + step]))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = shared.value

            def better(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
                best, top = best_of(x, block, metric)
                old = part.column(part.num_columns - 1).to_numpy()
                word = np.where(top > old, ids[best], part.column(part.num_columns - 2).to_numpy()).astype(np.int32)
                return pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(word), pa.array(np.maximum(top, old))], schema=part.schema)

            yield from _with_word(batches, at, to, better)

        out = out.mapInArrow(nearest, out.schema)
    return out.drop("__score")


def nearest_word(vocabulary: DataFrame, metric: str = "cosine", column: str = "descriptor") -> Column:
    """The same as one built-in expression, for small vocabularies: the centers are a constant of the plan."""
    words, centers = matrix(vocabulary)
    if not len(words):
        return F.lit(-1)
    known = F.array(*[F.struct(F.lit(int(w)).alias("w"), F.array(*map(F.lit, c.tolist())).alias("c")) for w, c in zip(words, centers)])
    x = F.col(column)
    if metric == "euclidean":
        value = lambda c: -vectors.squared_l2(x, c["c"])
    else:
        value = lambda c: vectors.cosine(x, c["c"])
    best = F.array_max(F.filter(F.transform(known, lambda c: F.struct(value(c).alias("s"), (-c["w"]).alias("w"))), lambda s: s["s"].isNotNull()))
    return F.coalesce(-best["w"], F.lit(-1))


def levels(bottom: DataFrame) -> dict[int, Matrix]:
    """``(top_id, bot_id, center)`` as the bottom words and centers of each top word."""
    found = bottom.select("top_id", "bot_id", "center").orderBy("top_id", "bot_id").collect()
    own = {t: [r for r in found if r.top_id == t] for t in {r.top_id for r in found}}
    return {t: (np.array([r.bot_id for r in rows], np.int32), np.array([r.center for r in rows], float)) for t, rows in own.items()}


def assign_hierarchical(features: DataFrame, top: DataFrame | Matrix, bottom: DataFrame | dict[int, Matrix], bottom_k: int, metric: str = "cosine", column: str = "descriptor") -> DataFrame:
    """``features`` with ``top_id``, ``bot_id`` and ``word_id = top_id * bottom_k + bot_id``; -1 where there is no nearest.

    ``top`` is ``(top_id, center)``, ``bottom`` is ``(top_id, bot_id, center)``.
    """
    upper = top if isinstance(top, tuple) else top.select(F.col("top_id").alias("word_id"), "center")
    rows = assign(features, upper, metric, "top_id", column)
    by_top = bottom if isinstance(bottom, dict) else levels(bottom)
    shared = features.sparkSession.sparkContext.broadcast(by_top)
    rows = rows.withColumn("bot_id", F.lit(-1).cast("int"))
    at, top_at = rows.columns.index(column), rows.columns.index("top_id")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def choose(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
            tops, out = part.column(top_at).to_numpy(), np.full(len(x), -1, np.int32)
            for t in np.unique(tops):
                if t in shared.value:
                    ids, block = shared.value[t]
                    rows_ = np.flatnonzero(tops == t)
                    best, value = best_of(x[rows_], block, metric)
                    out[rows_] = np.where(value > -np.inf, ids[best], -1)
            return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out)], schema=part.schema)

        yield from _with_word(batches, at, "bot_id", choose)

    word = F.when((F.col("top_id") < 0) | (F.col("bot_id") < 0), -1).otherwise(F.col("top_id") * bottom_k + F.col("bot_id"))
    return rows.mapInArrow(within, rows.schema).withColumn("word_id", word)


def assign_forest(features: DataFrame, vocabulary: DataFrame | Matrix, trees: int = 8, dims: int = 5, budget: float = 0.05, seed: int = 7, to: str = "word_id", column: str = "descriptor") -> DataFrame:
    """``features`` with an approximately nearest word (Euclidean), by a best-first search in a forest of k-d trees."""
    words, centers = matrix(vocabulary)
    if not len(words):
        return features.withColumn(to, F.lit(-1).cast("int"))
    shared = features.sparkSession.sparkContext.broadcast((words, Forest(centers, trees, dims, seed)))
    at = features.columns.index(column)
    out = features.withColumn(to, F.lit(-1).cast("int"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, forest = shared.value

        def choose(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
            found = np.array([ids[forest.nearest(v, budget)] for v in x], np.int32)
            return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], schema=part.schema)

        yield from _with_word(batches, at, to, choose)

    return out.mapInArrow(search, out.schema)

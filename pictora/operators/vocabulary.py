"""Visual vocabularies: initial centers, Lloyd steps, and flat, hierarchical and approximate k-means.

Each step assigns descriptors on Arrow batches and adds up, in each partition, the sums, squared norms and counts of its
words; only those partial sums are shuffled, never descriptors. What the driver holds is the vocabulary, whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictora.functions import vectors
from pictora.operators.assign import Matrix, assign, assign_forest, assign_hierarchical, dense, matrix

CENTER = "word_id int, center array<double>"


@dataclass(frozen=True)
class Settings:
    """Fixed values as defaults: at most twenty steps, movement at most 0.001, residuals within a thousandth of a plateau."""

    k: int = 16
    max_iterations: int = 20
    movement: float = 0.001
    plateau: float = 0.001
    metric: str = "cosine"


@dataclass
class Training:
    """A vocabulary and how it came about: the residual sum of squares of each step, and why it stopped."""

    vocabulary: DataFrame
    residuals: list[float] = field(default_factory=list)
    reason: str = "iterations"


def first_rows(features: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The first k descriptors by key as centers 0 to k-1 (fewer if there are fewer)."""
    rows = features.select(key, F.col("descriptor").alias("center")).orderBy(key).limit(k)
    return rows.select((F.row_number().over(Window.orderBy(key)) - 1).cast("int").alias("word_id"), "center")


def hashed_rows(features: DataFrame, k: int, key: str = "vec_id", seed: int = 0) -> DataFrame:
    """k descriptors drawn by a digest of key and seed: the same at any partitioning, never fewer than there are."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary"))
    rows = features.select(draw.alias("draw"), key, F.col("descriptor").alias("center")).orderBy("draw", key).limit(k)
    return rows.select((F.row_number().over(Window.orderBy("draw", key)) - 1).cast("int").alias("word_id"), "center")


def sampled_rows(features: DataFrame, k: int, n: int | None = None, seed: int = 0) -> DataFrame:
    """k descriptors of a Bernoulli sample with 1.5 k rows on average, filled up by further samples if it came out short."""
    n = features.count() if n is None else n
    share = min(1.0, 1.5 * k / max(n, 1))
    for attempt in range(8):
        rows = features.select(F.col("descriptor").alias("center")).sample(False, min(1.0, share * 2**attempt), seed + attempt).limit(k).collect()
        if len(rows) == min(k, n):
            break
    return centers_frame(features, np.array([r.center for r in rows]))


def reservoir_rows(features: DataFrame, k: int, key: str = "vec_id", seed: int = 0) -> DataFrame:
    """A draw that favours later rows: each row after the first k replaces a random one with probability one half.

    A slot ends with its last replacement: a row replaces slot ``hash mod k`` where a hash bit says so, and of each slot the last such row counts.
    """
    first = first_rows(features, k, key)
    order = features.select(key, F.col("descriptor").alias("center"))
    start = order.orderBy(key).limit(k).agg(F.max(key)).first()[0]
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    later = order.where((F.col(key) > F.lit(start)) & (hashed.bitwiseAND(F.lit(1)) == 1)).withColumn("word_id", F.pmod(F.shiftright(hashed, 1), F.lit(k)).cast("int"))
    last = later.groupBy("word_id").agg(F.max_by("center", key).alias("newer"))
    return first.join(last, "word_id", "left").select("word_id", F.coalesce("newer", "center").alias("center"))


def centers_frame(like: DataFrame, centers: np.ndarray, words: np.ndarray | None = None) -> DataFrame:
    words = np.arange(len(centers)) if words is None else words
    return like.sparkSession.createDataFrame([(int(w), c.tolist()) for w, c in zip(words, centers)], CENTER)


def step(assigned: DataFrame) -> DataFrame:
    """One center update in built-in operations: ``(word_id, n, center, rss)`` from ``(word_id, descriptor)``.

    The residual is the sum of squared norms plus n times the center's squared norm less twice its product with the sum.
    """
    rows = assigned.where("word_id >= 0")
    stats = rows.groupBy("word_id").agg(F.count("*").alias("n"), F.sum(vectors.dot("descriptor", "descriptor")).alias("squares"))
    sums = rows.select("word_id", F.posexplode("descriptor").alias("axis", "value")).groupBy("word_id", "axis").agg(F.sum("value").alias("total"))
    whole = sums.groupBy("word_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "total"))), lambda s: s["total"]).alias("total"))
    joined = stats.join(whole, "word_id").withColumn("center", F.transform("total", lambda t: t / F.col("n")))
    rss = F.col("squares") + F.col("n") * vectors.dot("center", "center") - 2 * vectors.dot("center", "total")
    return joined.select("word_id", "n", "center", rss.alias("rss"))


def fast_step(assigned: DataFrame) -> DataFrame:
    """The same from partial sums that each partition makes of its Arrow batches."""
    at, word_at = assigned.columns.index("descriptor"), assigned.columns.index("word_id")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            words = batch.column(word_at).to_numpy()
            x = dense(batch.column(at))
            order = np.argsort(words, kind="stable")
            ids, start = np.unique(words[order], return_index=True)
            if not len(ids):
                continue
            total = np.add.reduceat(x[order], start, axis=0)
            square = np.add.reduceat((x * x).sum(axis=1)[order], start)
            count = np.diff(np.r_[start, len(words)])
            for w, t, q, n in zip(ids.tolist(), total, square, count.tolist()):
                if w >= 0:
                    old = sums.get(w)
                    sums[w] = [t, q, n] if old is None else [old[0] + t, old[1] + q, old[2] + n]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0].tolist() for s in sums.values()], pa.list_(pa.float64())), pa.array([float(s[1]) for s in sums.values()]), pa.array([s[2] for s in sums.values()], pa.int64())], ["word_id", "total", "squares", "n"])

    parts = assigned.mapInArrow(partial, "word_id int, total array<double>, squares double, n long")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    sums = parts.groupBy("word_id").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.collect_list("total").alias("totals"))
    total = F.aggregate(F.slice("totals", 2, F.size("totals")), F.element_at("totals", 1), add)
    sums = sums.select("word_id", "n", "squares", total.alias("total")).withColumn("center", F.transform("total", lambda t: t / F.col("n")))
    rss = F.col("squares") + F.col("n") * vectors.dot("center", "center") - 2 * vectors.dot("center", "total")
    return sums.select("word_id", "n", "center", rss.alias("rss"))


def movement(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(word_id, moved)``: how far each center that has descriptors moved."""
    before = old.select("word_id", F.col("center").alias("old_center"))
    return new.join(before, "word_id").select("word_id", vectors.l2("center", "old_center").alias("moved"))


def converged(moved: DataFrame, most: float) -> DataFrame:
    """One row: whether no center moved more than ``most``."""
    return moved.agg(F.coalesce(F.bool_and(F.col("moved") <= most), F.lit(True)).alias("converged"))


def empty_words(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("word_id"), "word_id", "left_anti")


def carry_empty(old: DataFrame, new: DataFrame) -> DataFrame:
    """New centers, and the old ones of words that lost all descriptors."""
    return new.select("word_id", "center").unionByName(empty_words(old, new).select("word_id", "center"))


def at_plateau(residuals: list[float], within: float) -> bool:
    """Whether the last residual lies within a share of the mean of the two before it; never before the third."""
    if len(residuals) < 3:
        return False
    mean = (residuals[-2] + residuals[-3]) / 2
    return mean != 0 and abs(residuals[-1] - mean) / mean < within


def lloyd(features: DataFrame, start: DataFrame, settings: Settings, assigner: Callable[[DataFrame, Matrix], DataFrame] | None = None) -> Training:
    """Steps until no center moves, the residuals reach a plateau, or the steps run out.

    The order of a step: carry over empty words, test movement (which they don't count in), only then record the residual and test the plateau.
    """
    words, centers = matrix(start)
    result = Training(start)
    choose = assigner or (lambda f, v: assign(f, v, settings.metric))
    place = {int(w): i for i, w in enumerate(words)}
    for _ in range(settings.max_iterations if len(words) else 0):
        new = fast_step(choose(features.select("descriptor"), (words, centers))).collect()
        moved, centers = 0.0, centers.copy()
        for r in new:
            i = place[r.word_id]
            moved = max(moved, float(np.linalg.norm(centers[i] - r.center)))
            centers[i] = r.center
        if moved <= settings.movement:
            result.reason = "movement"
            break
        result.residuals.append(sum(r.rss for r in new))
        if at_plateau(result.residuals, settings.plateau):
            result.reason = "plateau"
            break
    result.vocabulary = centers_frame(features, centers, words)
    return result


def flat(features: DataFrame, settings: Settings, start: DataFrame | None = None) -> Training:
    return lloyd(features, first_rows(features, settings.k) if start is None else start, settings)


def approximate(features: DataFrame, settings: Settings, start: DataFrame | None = None, **forest) -> Training:
    """k-means whose assignment is the forest's search (Euclidean)."""
    start = hashed_rows(features, settings.k) if start is None else start
    return lloyd(features, start, settings, lambda f, v: assign_forest(f, v, **forest))


def flat_ml(features: DataFrame, settings: Settings, seed: int = 0) -> DataFrame:
    """The library's k-means with its own initial centers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=settings.k, distanceMeasure=settings.metric, tol=settings.movement, maxIter=settings.max_iterations, seed=seed, featuresCol="v").fit(features.select(array_to_vector("descriptor").alias("v")))
    return centers_frame(features, np.array(model.clusterCenters()))


def hierarchical(features: DataFrame, top: Settings, bottom: Settings, key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """Two levels: ``(top_id, center)`` and ``(top_id, bot_id, word_id, center)``.

    All bottom vocabularies are trained together, a step for all of them at a time, so a top cluster that holds most descriptors
    is spread over all tasks like any other.
    """
    upper = flat(features, top).vocabulary.select(F.col("word_id").alias("top_id"), "center")
    placed = assign(features, upper.select(F.col("top_id").alias("word_id"), "center"), top.metric, "top_id").where("top_id >= 0")
    # A limit on the row number itself is seen by the optimizer, so each task sorts and sends no more than k rows of a top cluster.
    rank = F.row_number().over(Window.partitionBy("top_id").orderBy(key))
    start = placed.select("top_id", key, "descriptor").withColumn("rank", rank).where(F.col("rank") <= bottom.k)
    start = start.select((F.col("top_id") * bottom.k + F.col("rank") - 1).cast("long").alias("word_id"), F.col("descriptor").alias("center"))
    known = matrix(upper.select(F.col("top_id").alias("word_id"), "center"))

    def split(vocabulary: Matrix) -> dict[int, Matrix]:
        words, centers = vocabulary
        return {int(t): ((words[words // bottom.k == t] % bottom.k).astype(np.int32), centers[words // bottom.k == t]) for t in np.unique(words // bottom.k)}

    trained = lloyd(features, start, bottom, lambda f, v: assign_hierarchical(f, known, split(v), bottom.k, bottom.metric)).vocabulary
    word = F.col("word_id")
    return upper, trained.select(F.floor(word / bottom.k).cast("int").alias("top_id"), (word % bottom.k).cast("int").alias("bot_id"), word.cast("int").alias("word_id"), "center")


def scatter(features: DataFrame, top: int = 5) -> DataFrame:
    """``(axis, scatter)`` of the axes along which descriptors scatter most: sum of squares less n times the squared mean."""
    values = features.select(F.posexplode("descriptor").alias("axis", "value"))
    sums = values.groupBy("axis").agg((F.sum(F.col("value") * F.col("value")) - F.count("*") * F.avg("value") * F.avg("value")).alias("scatter"))
    return sums.orderBy(F.desc("scatter"), "axis").limit(top)

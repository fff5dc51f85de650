"""The engine's facades: build an index from features, search it, evaluate and fuse the rankings.

Each works on all queries at once. A step that a person takes between two facades (annotating the top results) is a
table that goes into the second.
"""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictora.functions import paths
from pictora.operators import bow, evaluate, fusion, index, vocabulary
from pictora.operators.assign import assign, assign_forest, assign_hierarchical
from pictora.sources import files, images, text

MODALITIES = ("vw", "tw", "vw_tw")


@dataclass(frozen=True)
class Config:
    """How a vocabulary is made: ``flat``, ``hierarchical`` or ``approximate``, and its sizes."""

    method: str = "flat"
    k: int = 16
    bottom_k: int = 4
    max_iterations: int = 20
    movement: float = 0.001
    train_metric: str = "cosine"
    metric: str = "cosine"

    def settings(self, k: int) -> vocabulary.Settings:
        return vocabulary.Settings(k, self.max_iterations, self.movement, metric=self.train_metric)


@dataclass
class Built:
    vocabulary: DataFrame
    assigned: DataFrame | None
    histograms: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    top: DataFrame | None = None


def quantize(features: DataFrame, words: DataFrame, top: DataFrame | None, config: Config) -> DataFrame:
    """``features`` with their words: of a two-level vocabulary top down, of another one at once."""
    if top is None:
        return assign(features, words, config.metric)
    return assign_hierarchical(features, top, words, config.bottom_k, config.metric)


def build(features: DataFrame, config: Config = Config()) -> Built:
    """Vocabulary, words and histograms of ``features(vec_id, image_id, descriptor)``."""
    began, top = time.time(), None
    if config.method == "hierarchical":
        top, words = vocabulary.hierarchical(features, config.settings(config.k), config.settings(config.bottom_k))
        if (found := words.select("top_id").distinct().count()) != config.k:
            warnings.warn(f"{config.k} top clusters wanted, {found} have descriptors", stacklevel=2)
    else:
        train = {"flat": vocabulary.flat, "approximate": vocabulary.approximate}[config.method]
        words = train(features, config.settings(config.k)).vocabulary
    clustered = time.time()
    assigned = quantize(features, words, top, config)
    return Built(words, assigned, bow.histograms(assigned), {"cluster": clustered - began}, top)


def build_all(spark: SparkSession, root: str, config: Config = Config(), features: str = "features") -> dict[str, Built]:
    """``build`` for each folder of ``root`` that holds a features table."""
    found = {}
    for folder in files.folders(spark, root):
        if any(p.rsplit("/", 1)[-1] == features for p in files.folders(spark, folder)):
            found[folder.rsplit("/", 1)[-1]] = build(spark.read.parquet(f"{folder}/{features}"), config)
    return found


def _features(decoded: DataFrame, folder: str) -> DataFrame:
    """``(vec_id, image_id, descriptor, ...)`` of decoded images, with ``folder`` in front of their keys."""
    from pictora.operators import sift

    found = sift.extract_features(decoded.withColumn("image_key", F.concat_ws("/", F.lit(folder), "image_key")))
    return found.withColumn("vec_id", F.xxhash64("image_id", "scale", "orientation", "x", "y"))


def build_from_images(spark: SparkSession, root: str, folder: str = "images", config: Config = Config()) -> Built:
    """From a folder of image files: decode, extract descriptors, and ``build``."""
    return build(_features(images.decode(spark, root), folder), config)


def run_images(spark: SparkSession, root: str, path: str, folder: str = "images", config: Config = Config()) -> Built:
    """From a folder of image files to a stored vocabulary and stored histograms, with the seconds of each step.

    Descriptors are extracted once and written, so that training reads them instead of the images.
    """
    began = time.time()
    _features(images.decode(spark, root), folder).write.mode("overwrite").parquet(f"{path}/features")
    extracted = time.time()
    built = build(spark.read.parquet(f"{path}/features"), config)
    clustered = time.time()
    save(spark, built, path, config)
    stored, _ = load(spark, path)
    stored.seconds = {"extract": extracted - began, "cluster": clustered - extracted, "frequency": time.time() - clustered}
    return stored


def save(spark: SparkSession, built: Built, path: str, config: Config) -> None:
    """Vocabulary (both levels of one that has two) and histograms as Parquet, the settings as a file of attributes."""
    built.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    if built.top is not None:
        built.top.write.mode("overwrite").parquet(f"{path}/top")
    built.histograms.write.mode("overwrite").parquet(f"{path}/histograms")
    text.write_config(spark, vars(config), f"{path}/conf")


def load(spark: SparkSession, path: str) -> tuple[Built, Config]:
    """What ``save`` wrote, to quantize and search with."""
    config = load_config(spark, path)
    top = spark.read.parquet(f"{path}/top") if config.method == "hierarchical" else None
    return Built(spark.read.parquet(f"{path}/vocabulary"), None, spark.read.parquet(f"{path}/histograms"), top=top), config


def load_config(spark: SparkSession, path: str) -> Config:
    found = text.read_config(spark, f"{path}/conf")
    return Config(**{k: type(getattr(Config(), k))(v) for k, v in found.items()})


def search(queries: DataFrame, histograms: DataFrame, captions: DataFrame, top: int | None = None, modalities: tuple[str, ...] = MODALITIES) -> tuple[DataFrame, DataFrame]:
    """Rankings of all queries in all modalities, and the joined collection they rank."""
    joined = bow.with_captions(histograms, captions)
    docs = bow.modalities(joined).where(F.col("modality").isin(*modalities))
    terms = bow.query_terms(queries, histograms).where(F.col("modality").isin(*modalities))
    return index.search(terms, index.weights(docs, terms), top), joined


def search_images(decoded: DataFrame, built: Built, config: Config, weighted: DataFrame, folder: str = "images", top: int | None = index.TOP) -> DataFrame:
    """Rankings for images that need not be in the collection: their descriptors are quantized by the stored vocabulary and looked up.

    ``weighted`` is a stored index (``index.read_index``). An image without descriptors has no words and so no ranking.
    """
    bags = bow.histograms(quantize(_features(decoded, folder), built.vocabulary, built.top, config))
    queries = bags.select(F.col("image_id").alias("query_img"), paths.folder("image_id").alias("category"), F.lit("").alias("keyword"))
    return index.search(bow.query_terms(queries, bags).where("modality = 'vw'"), weighted, top)


def evaluated(ranked: DataFrame, joined: DataFrame) -> DataFrame:
    """Average precision of each query and modality."""
    return evaluate.average_precision(ranked, bow.category_counts(joined))


def fused(ranked: DataFrame, joined: DataFrame, multiplier: float = 1.0, top: int | None = None) -> DataFrame:
    """The late fusion of textual and visual rankings, weighted by their average precision."""
    return fusion.fuse(ranked, fusion.weight(evaluated(ranked, joined), multiplier=multiplier), top=top)


def fused_by_annotation(ranked: DataFrame, annotated: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """The same weighted by the accuracy of annotated tops."""
    return fusion.fuse(ranked, fusion.weight(evaluate.accuracy(annotated).withColumnRenamed("accuracy", "ap"), multiplier=multiplier))


def multiplier_sweep(ranked: DataFrame, joined: DataFrame, multipliers: tuple[float, ...]) -> DataFrame:
    """``(multiplier, mean_ap)`` of the fusion for each multiplier."""
    relevant, rows = bow.category_counts(joined), None
    for m in multipliers:
        each = fused(ranked, joined, m).withColumn("modality", F.lit("fused"))
        one = evaluate.mean_average_precision(evaluate.average_precision(each, relevant)).select(F.lit(float(m)).alias("multiplier"), "mean_ap")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def top_with_text(ranked: DataFrame, captions: DataFrame, top: int = 5) -> DataFrame:
    """The top results with their captions, for a person to annotate; documents without a caption have a null text."""
    best = ranked.where(F.col("rank") < top)
    return best.join(captions.select(F.col("image_id").alias("doc_id"), F.col("caption").alias("text")), "doc_id", "left")


def write_bundle(spark: SparkSession, best: DataFrame, root: str, path: str) -> None:
    """The few top results of one query and modality for a person to annotate.

    ``top.txt`` has a line ``TAB rank TAB number TAB text`` for each (``text.read_annotations`` reads it once it is filled in); the
    image files, which lie below ``root`` at their ids, are copied next to it, named by rank.
    """
    if best.select("modality", "query_img").distinct().limit(2).count() > 1:
        raise ValueError("a bundle holds the results of one query")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    rows = best.orderBy("rank")
    line = F.concat_ws("\t", F.lit(""), F.col("rank").cast("string"), paths.stem("doc_id"), plain)
    rows.coalesce(1).select(line).write.mode("overwrite").text(f"{path}/top.txt")
    files.make(spark, f"{path}/images")
    for r in rows.select("rank", "doc_id").toLocalIterator():
        if files.exists(spark, f"{root}/{r.doc_id}"):
            files.copy(spark, f"{root}/{r.doc_id}", f"{path}/images/{r['rank']}-{r.doc_id.rsplit('/', 1)[-1]}")


def write_reports(ranked: DataFrame, joined: DataFrame, path: str) -> None:
    """Average precisions by modality and all together, each query's ranking with its precisions, and the means."""
    ap = evaluated(ranked, joined).cache()
    ap.select("modality", "query_img", "category", "ap").repartitionByRange("modality").sortWithinPartitions("modality", "query_img").write.mode("overwrite").option("sep", "\t").partitionBy("modality").csv(f"{path}/ap")
    text.write_report(ap.select("query_img", "modality", "ap"), f"{path}/ap_all", "query_img", "modality")
    ranks = evaluate.precision_at(ranked).select("modality", "query_img", "rank", "doc_id", "relevant", "precision")
    ranks.sortWithinPartitions("modality", "query_img", "rank").write.mode("overwrite").option("sep", "\t").partitionBy("modality", "query_img").csv(f"{path}/ranks")
    text.write_report(evaluate.mean_average_precision(ap), f"{path}/mean_ap", "modality")
    ap.unpersist()


def compare_forest(features: DataFrame, words: DataFrame, **forest: float) -> dict[str, float]:
    """The forest against the exact search: the share of equal words, the seconds of both, and how many times faster it is."""
    exact, near = assign(features, words, "euclidean", "exact"), assign_forest(features, words, to="near", **forest)
    seconds = []
    for rows in (exact, near):
        began = time.time()
        rows.write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - began)
    both = assign_forest(exact, words, to="near", **forest)
    return {"recall": both.agg(evaluate.share_equal("near", "exact")).first()[0], "exact_s": seconds[0], "near_s": seconds[1], "speedup": seconds[0] / seconds[1]}

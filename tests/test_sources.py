import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictora.operators import bow, sift
from pictora.plans import pipeline
from pictora.sources import files, images, text


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    """Small pictures that the JVM writes, an empty file, a broken one, and files that are no images."""
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(3)
    jvm = spark._jvm
    for k in range(4):
        folder = root / f"c{k % 2}"
        folder.mkdir(exist_ok=True)
        shade = rng.integers(0, 256, (8, 8)).repeat(8, 0).repeat(8, 1)
        image = jvm.java.awt.image.BufferedImage(64, 64, 10)
        raster = image.getRaster()
        for y in range(64):
            for x in range(64):
                raster.setSample(x, y, 0, int(shade[y, x]))
        jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(str(folder / f"{k}.png")))
    (root / "c0" / "empty.jpg").write_bytes(b"")
    (root / "c0" / "broken.jpg").write_bytes(b"no image")
    (root / "c0" / "a b.png").write_bytes(b"x")
    (root / "c0" / "1.png~").write_bytes(b"x")
    (root / "c0" / "note.txt").write_text("x")
    return str(root)


def test_scan_and_pack(spark, pictures, tmp_path):
    found = images.scan(spark, pictures)
    assert sorted(r.image_key for r in found.select("image_key").collect()) == ["c0/0.png", "c0/2.png", "c0/broken.jpg", "c1/1.png", "c1/3.png"]
    assert images.scan(spark, pictures, largest=8).count() == 1
    images.pack(found, str(tmp_path / "packed"))
    assert {r.image_key for r in images.unpack(spark, str(tmp_path / "packed"), "all").collect()} >= {"all/c1/3.png"}
    images.pack_sequence(found, str(tmp_path / "seq"))
    assert sorted(images.unpack_sequence(spark, str(tmp_path / "seq")).collect()) == sorted(found.collect())


def test_broken_images_are_skipped_and_descriptors_are_found(spark, pictures):
    decoded = images.decode(spark, pictures)
    assert decoded.count() == 4
    found = sift.extract_features(decoded).collect()
    assert {r.image_id for r in found} == {"c0/0.png", "c0/2.png", "c1/1.png", "c1/3.png"}
    d = np.array([r.descriptor for r in found])
    assert d.shape[1] == 128 and (d >= 0).all() and np.allclose(np.linalg.norm(d, axis=1), 1)


def test_descriptors_move_with_the_picture():
    rng = np.random.default_rng(4)
    big = sift.blur(rng.random((120, 120)), 2.0)
    big = (big - big.min()) / (big.max() - big.min())
    a, b = sift.extract(big[:100, :100]), sift.extract(big[8:108, 8:108])
    moved = {(round(p[2] - 8), round(p[3] - 8)): np.array(p[4]) for p in a}
    near = [np.linalg.norm(moved[k] - np.array(p[4])) for p in b if (k := (round(p[2]), round(p[3]))) in moved and 25 < p[2] < 70 and 25 < p[3] < 70]
    assert near and np.median(near) < 0.1
    assert sift.extract(np.full((40, 40), 0.5)) == [] and sift.extract(np.zeros((5, 5))) == []


def test_end_to_end_from_images(spark, pictures, tmp_path):
    config = pipeline.Config(k=8)
    built = pipeline.build_from_images(spark, pictures, config=config)
    rows = {r.image_id: r for r in built.histograms.collect()}
    assert set(rows) == {"images/c0/0.png", "images/c0/2.png", "images/c1/1.png", "images/c1/3.png"} and all(r.total == len(r.words) for r in rows.values())
    captions = spark.createDataFrame([(f"c{k % 2}/{k}", f"tower number {k}", k) for k in range(4)], "key string, caption string, line long")
    queries = spark.createDataFrame([("images/c0/0.png", "c0", "tower")], "query_img string, category string, keyword string")
    ranked, joined = pipeline.search(queries, built.histograms, captions)
    assert ranked.where("modality = 'vw' and rank = 0").first().doc_id == "images/c0/0.png"
    assert ranked.where("modality = 'tw'").count() == 4
    assert pipeline.multiplier_sweep(ranked, joined, (1.0, 1.1)).count() == 2
    assert pipeline.fused_by_annotation(ranked, ranked.where("rank < 5").withColumn("relevant", F.lit(1))).count() == 4
    pipeline.save(spark, built, str(tmp_path / "built"), config)
    assert pipeline.load_config(spark, str(tmp_path / "built")) == config


@pytest.mark.parametrize("method", ["hierarchical", "approximate"])
def test_other_vocabularies(spark, sf_dir, method):
    from pictora.sources import adapters

    features = adapters.features(spark, sf_dir)
    built = pipeline.build(features, pipeline.Config(method=method, k=4, train_metric="euclidean", max_iterations=3))
    assert built.histograms.agg(F.sum("total")).first()[0] == features.count() and built.seconds["cluster"] > 0


def lines(path, *rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")
    return str(path)


def test_vocabulary_text(spark, tmp_path):
    path = lines(f"{tmp_path}/v/clusters.txt", "0\t{1.0,2.5,0.0}", "1\t{0:0.5, 2:-1.0}", "2\t{}", "")
    found = text.read_vocabulary(spark, path, 3)
    assert {r.word_id: r.center for r in found.collect()} == {0: [1.0, 2.5, 0.0], 1: [0.5, 0.0, -1.0], 2: [0.0] * 3}
    text.write_vocabulary(found, f"{tmp_path}/again")
    assert sorted(text.read_vocabulary(spark, f"{tmp_path}/again", 3).collect()) == sorted(found.collect())
    assert text.checked_vocabulary(found, 3) is found
    with pytest.raises(ValueError, match="3 ids"):
        text.checked_vocabulary(found.unionByName(found.limit(1)), 3)


def test_descriptor_lines(spark):
    df = spark.createDataFrame([("1.5 0.1 10 20 0.5 0.25 1",), ("1 2 3 4",)], "line string").select(text.descriptor("line").alias("d"))
    assert [r.d for r in df.collect()] == [[0.5, 0.25, 1.0], []]


def test_histograms_terms_and_index_documents(spark, tmp_path):
    h = spark.createDataFrame([("a b/1.jpg", 3, [1, 1, 7])], "image_id string, total long, words array<int>")
    text.write_histograms(h, f"{tmp_path}/h")
    assert text.read_histograms(spark, f"{tmp_path}/h").collect() == h.collect()
    assert text.read_index_documents(spark, f"{tmp_path}/h").first().terms == ["1", "1", "7"]
    text.write_terms(h.select("image_id", F.lit(2).alias("n"), bow.visual_terms().alias("terms")), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").first().value == "a b/1.jpg\t2\tvw1 vw1 vw7"


def test_captions_queries_rankings_annotations(spark, tmp_path):
    lines(f"{tmp_path}/caps/Pisa/map.txt", "1.jpg --- --- leaning --- x", "2.jpg --- ", "1.jpg --- later")
    got = text.read_captions(spark, f"{tmp_path}/caps/*/map.txt").collect()
    assert [tuple(r) for r in got] == [("Pisa", "1.jpg", "later")]
    assert [tuple(r) for r in text.read_captions_by_number(spark, lines(f"{tmp_path}/n/m.txt", "77.jpg --- hi", "x.jpg --- no")).collect()] == [(77, "hi")]
    a = text.read_queries(spark, lines(f"{tmp_path}/qa.txt", "Pisa P1.jpg P2.jpg"))
    b = text.read_queries(spark, lines(f"{tmp_path}/qb.txt", "pisa tower---Pisa---P1.jpg P2.jpg"), "---")
    assert sorted(map(tuple, a.collect())) == [("Pisa", "Pisa", "P1.jpg"), ("Pisa", "Pisa", "P2.jpg")]
    assert sorted(map(tuple, b.collect())) == [("Pisa", "pisa tower", "P1.jpg"), ("Pisa", "pisa tower", "P2.jpg")]
    ranked = spark.createDataFrame([("q", "vw", 0, "d"), ("q", "tw", 0, "e")], "query_img string, modality string, rank int, doc_id string")
    text.write_rankings(ranked, f"{tmp_path}/ranked")
    assert text.read_rankings(spark, f"{tmp_path}/ranked").where("modality = 'tw'").first().doc_id == "e"
    notes = text.read_annotations(spark, lines(f"{tmp_path}/notes.txt", "1\t0\t6088\tsome text", "\t1\t6089\tother"))
    assert [tuple(r) for r in notes.orderBy("rank").collect()] == [(1, 0, 6088, "some text"), (None, 1, 6089, "other")]
    with pytest.raises(Exception, match="not an annotation"):
        text.read_annotations(spark, lines(f"{tmp_path}/bad.txt", "0x\t1\t2\t3")).collect()


def test_config_reports_and_files(spark, tmp_path):
    values = {"terms": "a/b.txt", "clusters": "c", "clusterNum": "9"}
    text.write_config(spark, values, f"{tmp_path}/conf")
    assert text.read_config(spark, f"{tmp_path}/conf") == values
    text.write_report(spark.createDataFrame([("b", 0.5), ("a", 1.0)], "k string, ap double"), f"{tmp_path}/report", "k")
    assert spark.read.text(f"{tmp_path}/report").collect()[0].value == "a\t1.0"
    root = str(tmp_path / "fs")
    files.make(spark, f"{root}/_skip"), files.make(spark, f"{root}/set")
    lines(f"{root}/x.txt", "1")
    assert [p.rsplit("/", 1)[-1] for p in files.folders(spark, root)] == ["set"] and [p.rsplit("/", 1)[-1] for p in files.files(spark, root)] == ["x.txt"]
    assert files.copy(spark, f"{root}/x.txt", f"{root}/set/y.txt") and files.rename(spark, f"{root}/x.txt", f"{root}/set/y.txt").endswith("y.txt-1")
    assert files.delete(spark, root) and not os.path.exists(root)


def test_index_is_replaced(spark, tmp_path):
    from pictora.operators import index

    docs = spark.createDataFrame([("tw", "d1", "c", ["a"]), ("tw", "d2", "c", ["b"])], "modality string, image_id string, category string, terms array<string>")
    assert index.write_index(docs, f"{tmp_path}/i") == 2 and index.write_index(docs.limit(1), f"{tmp_path}/i") == 1
    assert index.read_index(spark, f"{tmp_path}/i").count() == 1


def test_stream_of_descriptors(spark, sf_dir, tmp_path):
    from pictora.operators import vocabulary
    from pictora.operators.assign import assign
    from pictora.sources import adapters
    from pictora.streaming import quantize

    features = adapters.features(spark, sf_dir).select("vec_id", "image_id", "descriptor")
    words = vocabulary.first_rows(features, 8)
    features.select("image_id", "descriptor").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = quantize.read_features(spark, f"{tmp_path}/in")
    quantize.write_words(stream, words, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    want = sorted(map(tuple, assign(features, words).select("image_id", "word_id").collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    counts = quantize.word_counts(stream, words).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.sql("select sum(tf) from counts").first()[0] == len(want)


def test_every_data_set_of_a_root(spark, sf_dir, tmp_path):
    from pictora.sources import adapters

    for name in ("one", "two"):
        adapters.features(spark, sf_dir).limit(40).write.parquet(f"{tmp_path}/{name}/features")
    (tmp_path / "none").mkdir()
    built = pipeline.build_all(spark, str(tmp_path), pipeline.Config(k=3, max_iterations=1))
    assert set(built) == {"one", "two"} and all(b.histograms.agg(F.sum("total")).first()[0] == 40 for b in built.values())


def test_stored_two_level_vocabulary_and_search_for_an_image(spark, pictures, tmp_path):
    """An image outside the collection is quantized top down by the stored vocabulary; one that is inside finds itself first."""
    from pictora.operators import index

    config = pipeline.Config(method="hierarchical", k=3, bottom_k=4, max_iterations=2)
    built = pipeline.run_images(spark, pictures, f"{tmp_path}/run", config=config)
    assert set(built.seconds) == {"extract", "cluster", "frequency"} and min(built.seconds.values()) > 0
    stored, read = pipeline.load(spark, f"{tmp_path}/run")
    assert read == config and stored.top.count() == 3
    features = spark.read.parquet(f"{tmp_path}/run/features")
    again = bow.histograms(pipeline.quantize(features, stored.vocabulary, stored.top, config))
    assert sorted(again.collect()) == sorted(stored.histograms.collect())

    docs = stored.histograms.select(F.lit("vw").alias("modality"), "image_id", bow.visual_terms().alias("terms"))
    index.write_index(docs, f"{tmp_path}/index")
    decoded = images.decode(spark, pictures)
    found = pipeline.search_images(decoded, stored, config, index.read_index(spark, f"{tmp_path}/index"))
    assert {r.query_img: r.doc_id for r in found.where("rank = 0").collect()} == {k: k for k in (f"images/c{n % 2}/{n}.png" for n in range(4))}
    outside = pipeline.search_images(decoded.limit(1), stored, config, index.read_index(spark, f"{tmp_path}/index"), "new", top=2)
    assert sorted(r["rank"] for r in outside.collect()) == [0, 1]
    with pytest.warns(UserWarning, match="50 top clusters wanted"):
        pipeline.build(features.limit(20), pipeline.Config(method="hierarchical", k=50, bottom_k=2, max_iterations=1))


def test_levels_and_clusters_on_disk(spark, tmp_path):
    top = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.5])], "top_id int, center array<double>")
    bottom = spark.createDataFrame([(0, 0, [1.0, 0.5]), (1, 0, [0.0, 1.0]), (1, 1, [0.5, 1.0])], "top_id int, bot_id int, center array<double>")
    text.write_levels(top, bottom, f"{tmp_path}/levels")
    upper, lower = text.read_levels(spark, f"{tmp_path}/levels", 2)
    assert sorted(upper.collect()) == sorted(top.collect()) and sorted(lower.select(bottom.columns).collect()) == sorted(bottom.collect())
    several = text.read_vocabulary(spark, [f"{tmp_path}/levels/level=1/top_id={t}" for t in (0, 1)], 2)
    assert sorted(r.word_id for r in several.collect()) == [0, 0, 1]
    placed = spark.range(100).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 3).alias("top_id"))
    text.write_by_cluster(placed, f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/split/top_id=0").count() == placed.where("top_id = 0").count()
    assert sorted(spark.read.parquet(f"{tmp_path}/split").select("vec_id").collect()) == sorted(placed.select("vec_id").collect())


def test_bundles_and_reports(spark, pictures, tmp_path):
    rows = [("vw", "images/c0/0.png", "c0", f"c{k % 2}/{k}.png", k) for k in range(4)] + [("vw", "images/c0/0.png", "c0", "c0/gone.png", 4)]
    ranked = spark.createDataFrame(rows, "modality string, query_img string, category string, doc_id string, rank int")
    captions = spark.createDataFrame([("c0/0.png", "two\tlines\nof text")], "image_id string, caption string")
    pipeline.write_bundle(spark, pipeline.top_with_text(ranked, captions), pictures, f"{tmp_path}/bundle")
    assert sorted(p.name for p in (tmp_path / "bundle/images").iterdir() if p.suffix == ".png") == [f"{k}-{k}.png" for k in range(4)]
    assert (tmp_path / "bundle/images/3-3.png").read_bytes() == open(f"{pictures}/c1/3.png", "rb").read()
    lines_ = [r.value for r in spark.read.text(f"{tmp_path}/bundle/top.txt").collect()]
    assert lines_[0] == "\t0\t0\ttwo lines of text" and lines_[4] == "\t4\tgone\t" and len(lines_) == 5
    with pytest.raises(ValueError, match="one query"):
        pipeline.write_bundle(spark, ranked.unionByName(ranked.withColumn("modality", F.lit("tw"))), pictures, f"{tmp_path}/two")

    joined = spark.createDataFrame([(f"c{k % 2}/{k}.png", f"c{k % 2}") for k in range(4)], "image_id string, category string")
    pipeline.write_reports(ranked.withColumn("doc_id", F.concat(F.lit("images/"), "doc_id")).where("rank < 4"), joined, f"{tmp_path}/reports")
    assert spark.read.text(f"{tmp_path}/reports/ap_all").first().value.split("\t")[:2] == ["images/c0/0.png", "vw"]
    assert spark.read.option("sep", "\t").csv(f"{tmp_path}/reports/ranks").count() == 4
    assert spark.read.text(f"{tmp_path}/reports/mean_ap").count() == 1 and spark.read.csv(f"{tmp_path}/reports/ap").count() == 1


def test_forest_against_the_exact_search(spark, sf_dir):
    from pictora.operators import vocabulary
    from pictora.sources import adapters

    features = adapters.features(spark, sf_dir)
    found = pipeline.compare_forest(features, vocabulary.first_rows(features, 8), budget=1.0)
    assert found["recall"] == 1.0 and found["speedup"] > 0

"""Golden cases and properties that the tables don't hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictora.functions import paths, vectors
from pictora.operators import bow, evaluate, fusion, index, vocabulary
from pictora.operators.assign import assign, assign_forest, nearest_word
from pictora.operators.forest import Forest, top_axes


def features(spark, rows):
    return spark.createDataFrame([(i, f"images/c{i % 2}/{i}.jpg", [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, image_id string, descriptor array<double>")


def words(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "word_id int, center array<double>")


@pytest.mark.parametrize("block", [8_000_000, 2])
def test_assignment_edge_cases(spark, monkeypatch, block):
    """Zero descriptor: -1. Zero center: never chosen by cosine. Equal centers: the lower word."""
    monkeypatch.setattr("pictora.operators.assign.BLOCK_VALUES", block)
    f, v = features(spark, [(0, 0), (1, 0), (0, 2), (-1, -1)]), words(spark, [(0, 0), (3, 0), (1, 0), (0, 1)])
    want = {0: -1, 1: 1, 2: 3, 3: 1}
    assert {r.vec_id: r.word_id for r in assign(f, v).collect()} == want
    assert {r.vec_id: r.w for r in f.select("vec_id", nearest_word(v).alias("w")).collect()} == want
    assert {r.vec_id: r.word_id for r in assign(f, v, "euclidean").collect()} == {0: 0, 1: 2, 2: 3, 3: 0}
    assert {r.word_id for r in assign(f, v.where("false")).collect()} == {-1}


def test_forest_is_exact_with_a_full_budget_and_good_below():
    rng = np.random.default_rng(1)
    points, queries = rng.normal(size=(400, 16)), rng.normal(size=(60, 16))
    exact = [int(np.linalg.norm(points - q, axis=1).argmin()) for q in queries]
    forest = Forest(points)
    assert [forest.nearest(q, 1.0) for q in queries] == exact
    recall = [np.mean([forest.nearest(q, b) == e for q, e in zip(queries, exact)]) for b in (0.05, 0.3)]
    assert recall[0] <= recall[1] + 0.05 and recall[1] > 0.7
    assert top_axes(np.array([[0.0, 1, 5], [0, -1, -5]]), 2).tolist() == [2, 1]


def test_lloyd_lowers_residuals_and_carries_empty_words(spark):
    rng = np.random.default_rng(2)
    f = features(spark, np.r_[rng.normal(0, 1, (60, 3)), rng.normal(8, 1, (60, 3))])
    start = words(spark, [(0, 0, 1), (1, 0, 0), (8, 8, 8), (500, 500, 500)])
    got = vocabulary.lloyd(f, start, vocabulary.Settings(4, metric="euclidean", plateau=0))
    assert all(a >= b - 1e-9 for a, b in zip(got.residuals, got.residuals[1:])) and got.reason == "movement"
    assert got.vocabulary.where("word_id = 3").first().center == [500.0] * 3
    assert vocabulary.lloyd(f, start, vocabulary.Settings(4, metric="euclidean", movement=-1, plateau=0.5)).reason == "plateau"


def test_plateau_needs_three_values():
    assert not vocabulary.at_plateau([1.0, 1.0], 0.1) and vocabulary.at_plateau([9.0, 1.0, 5.0], 0.1) and not vocabulary.at_plateau([9.0, 1.0, 4.0], 0.1)


def test_movement_equal_to_the_threshold_has_converged(spark):
    moved = spark.createDataFrame([(0, 0.5), (1, 0.25)], "word_id int, moved double")
    assert vocabulary.converged(moved, 0.5).first()[0] and not vocabulary.converged(moved, 0.49).first()[0]
    assert vocabulary.converged(moved.where("false"), 0).first()[0]


def test_more_words_than_points(spark):
    f = features(spark, [(1, 0), (0, 1)])
    for start in (vocabulary.first_rows(f, 5), vocabulary.hashed_rows(f, 5), vocabulary.sampled_rows(f, 5), vocabulary.reservoir_rows(f, 5)):
        assert start.count() == 2
    assert vocabulary.flat(f, vocabulary.Settings(5)).vocabulary.count() == 2
    top, bottom = vocabulary.hierarchical(f, vocabulary.Settings(2), vocabulary.Settings(3))
    assert sorted(r.word_id for r in bottom.collect()) == [0, 3]


def test_draws_of_initial_centers(spark):
    f = features(spark, np.arange(300).reshape(100, 3))
    for n in (1, 7):
        assert vocabulary.hashed_rows(f.repartition(n), 10, seed=3).collect() == vocabulary.hashed_rows(f, 10, seed=3).collect()
    assert vocabulary.sampled_rows(f, 20).count() == 20
    later = vocabulary.reservoir_rows(f, 4).collect()
    assert len(later) == 4 and all(r.center[0] >= 12 for r in later)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(vectors.norm("a"), vectors.unit("a"), vectors.unit("b"), vectors.cosine("a", "b"), vectors.l2("a", "b")).first()
    assert tuple(row) == (5.0, [0.6, 0.8], [0.0, 0.0], None, 5.0)


def test_captions_and_paths(spark):
    rows = spark.createDataFrame([("1.jpg --- --- tower --- x",), ("1.jpg",), ("1.jpg ---",), (None,)], "line string").select(paths.first_segment("line").alias("c"), paths.name("line")).collect()
    assert [r.c for r in rows] == ["tower", None, None, None]
    one = spark.createDataFrame([("a/b/c.d.jpg", "x.png")], "p string, q string").select(paths.stem("p"), paths.folder("p"), paths.folder("q"), paths.relevance("p", F.lit("b")), paths.relevance("q", F.lit("b")), paths.caption_key(F.lit("k"), "p"), paths.words(F.lit("  A  b\n"))).first()
    assert tuple(one) == ("c", "b", None, 1, 0, "k/c", ["a", "b"])


def test_caption_join_keeps_the_last_line_and_drops_images_without(spark):
    h = spark.createDataFrame([("images/c/1.jpg", 3, [-1, 2, 2]), ("images/c/2.jpg", 1, [0])], "image_id string, total long, words array<int>")
    c = spark.createDataFrame([("c/1", "old", 1), ("c/1", "New words", 2)], "key string, caption string, line long")
    rows = bow.with_captions(h, c).collect()
    assert [(r.image_id, r.vw, r.tw, r.n_vw, r.n_tw) for r in rows] == [("images/c/1.jpg", ["vw2", "vw2"], ["new", "words"], 2, 2)]


def ranking(spark, rows):
    return spark.createDataFrame(rows, "modality string, query_img string, category string, doc_id string, rank int")


def test_average_precision(spark):
    r = ranking(spark, [("vw", "q", "c", f"images/{c}/{i}.jpg", i) for i, c in enumerate("cxcx")] + [("tw", "q", "c", f"images/c/{i}.jpg", i) for i in range(2)] + [("vw", "p", "z", "images/c/0.jpg", 0)])
    relevant = spark.createDataFrame([("c", 2), ("z", 0)], "category string, n long")
    got = {(x.modality, x.query_img): x.ap for x in evaluate.average_precision(r, relevant).collect()}
    assert got == {("vw", "q"): pytest.approx((1 + 2 / 3) / 2), ("tw", "q"): 1.0, ("vw", "p"): 0.0}
    short = spark.createDataFrame([("c", 4)], "category string, n long")  # relevant ones that were not found count
    assert evaluate.average_precision(r, short).where("modality = 'tw'").first().ap == 0.5


def test_fusion(spark):
    r = ranking(spark, [("tw", "q", "c", d, i) for i, d in enumerate("ab")] + [("vw", "q", "c", d, i) for i, d in enumerate("cba")])
    ap = lambda a, b: spark.createDataFrame([("tw", "q", a), ("vw", "q", b)], "modality string, query_img string, ap double")
    assert fusion.weight(ap(0.0, 0.0)).first()["lambda"] == 0.5
    assert fusion.weight(ap(0.6, 0.2)).first()["lambda"] == pytest.approx(0.75)
    assert fusion.weight(ap(0.6, 0.0), multiplier=1.1).first()["lambda"] == pytest.approx(1.1)
    order = lambda w: [x.doc_id for x in fusion.fuse(r, spark.createDataFrame([("q", w)], "query_img string, lambda double")).orderBy("rank").collect()]
    assert order(1.0) == ["a", "b", "c"] and order(0.0) == ["c", "b", "a"]
    fused = {x.doc_id: x.fused for x in fusion.fuse(r, fusion.weight(ap(0.5, 0.5))).collect()}
    assert fused == {"a": 1.0, "b": 1.0, "c": 1.5}  # c is not in the textual ranking: rank 3 there


def test_accuracy_leaves_out_what_nobody_annotated(spark):
    rows = spark.createDataFrame([("vw", "q", 1), ("vw", "q", 0), ("vw", "q", None), ("tw", "q", None)], "modality string, query_img string, relevant int")
    got = evaluate.accuracy(rows)
    assert [(r.modality, r.accuracy, r.n_annotated) for r in got.collect()] == [("vw", 0.5, 2)]
    assert tuple(evaluate.accuracy_summary(got, ("vw", "tw")).first()) == (0.5, None)


def test_scores_by_hand(spark):
    docs = spark.createDataFrame([("tw", "d1", "c", ["a", "a", "b", "c"]), ("tw", "d2", "c", ["b"])], "modality string, image_id string, category string, terms array<string>")
    terms = spark.createDataFrame([("tw", "q", "c", "a", 1), ("tw", "q", "c", "b", 2), ("tw", "q", "c", "zz", 1)], "modality string, query_img string, category string, term string, qtf long")
    a, b = 1 + np.log(2 / 2), 1 + np.log(2 / 3)
    got = {r.doc_id: (r.score, r["rank"]) for r in index.search(terms, index.weights(docs)).collect()}
    d1, d2 = (np.sqrt(2) * a * a / 2 + 2 * b * b / 2) * 3 / 4, 2 * b * b / 1 * 2 / 4
    assert got["d1"][0] == pytest.approx(d1) and got["d2"][0] == pytest.approx(d2) and got["d1"][1] == (0 if d1 > d2 else 1)
    assert index.search(terms, index.weights(docs), top=1).count() == 1


def test_forest_assignment_of_an_empty_vocabulary(spark):
    f = features(spark, [(1, 0)])
    assert assign_forest(f, words(spark, []).where("false")).first().word_id == -1


def test_scores_of_many_words_stay_in_tiles(monkeypatch):
    """Tiles give the same words as one matrix, ties included, and never hold more scores than stated."""
    import numpy as np

    from pictora.operators import assign as module

    rng = np.random.default_rng(1)
    x, centers = rng.normal(size=(50, 8)), rng.normal(size=(900, 8))
    centers[500] = centers[3]
    x[0] = centers[3]
    whole = {m: module.scores(x, centers, m) for m in ("cosine", "euclidean")}
    monkeypatch.setattr(module, "TILE", 50 * 64)
    seen, plain = [], module.scores
    monkeypatch.setattr(module, "scores", lambda *a: seen.append(a[0].shape[0] * a[1].shape[0]) or plain(*a))
    for metric, want in whole.items():
        at, top = module.best_of(x, centers, metric)
        assert (top == want.max(axis=1)).all() if metric == "cosine" else np.allclose(top, want.max(axis=1))
        assert at[0] == 3
    assert max(seen) <= 50 * 64


def test_weights_of_the_whole_index_move_few_postings(spark, sf_dir):
    """Terms are counted within documents and common terms' frequencies are broadcast, so what is shuffled is of the size of the text."""
    from pictora import catalog

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    catalog.tfidf_weights(spark, sf_dir).write.format("noop").mode("overwrite").save()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert 0 < written() - before < 3 * text


@pytest.mark.parametrize("common", [0, 3, 200_000])
def test_joint_weights_are_those_of_each_modality(spark, monkeypatch, common):
    """With a caption that says a visual term, one without words, repeats, a descriptor without a word, and terms on either side of the broadcast."""
    monkeypatch.setattr(index, "COMMON_TERMS", common)
    places = [(f"images/c/{i}.jpg", w) for i, ws in enumerate([(1, 1, 2), (2, -1), (1,), (3, 2)]) for w in ws]
    assigned = spark.createDataFrame(places, "image_id string, word_id int")
    said = spark.createDataFrame([("c/0", "b a b vw1", 1), ("c/1", " ", 1), ("c/2", "a B\tc  a", 1), ("c/3", "old", 1), ("c/3", "vw2 a vw9", 2)], "key string, caption string, line long")
    docs = bow.modalities(bow.with_captions(bow.histograms(assigned), said))
    images, number = bow.counted_terms(assigned), spark.createDataFrame([(4,)], "n_docs long")
    rows = lambda df: sorted((r.modality, r.term, r.doc_id, r.tf, round(r.weight, 9)) for r in df.collect())
    got = rows(index.joint_weights(bow.joint_postings(images, bow.counted_captions(said)), number))
    assert got == rows(index.weights(docs)) and ("vw_tw", "vw1", "images/c/0.jpg", 3) in [r[:4] for r in got]

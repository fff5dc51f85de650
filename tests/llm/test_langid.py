import numpy as np
from pyspark.sql import functions as F

from pictora.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_mixture_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    de, en = (docs.where(f"lang = '{x}' and n_chars between 2500 and 3500").first().text[:2400] for x in ("de", "en"))
    langs, scores = model.predict([de + " " + en[:1200], de, en, "", "123", de[:1200] + " " + en])
    assert langs == ["de", "de", "en", "und", "und", "en"]
    assert 0.55 < scores[0] < 0.8 and scores[1] == scores[2] == 1 and scores[3] == 0 and 0.55 < scores[5] < 0.8


def test_trigrams_of_a_batch_are_those_of_each_text():
    texts = ["Ab cd!", "", "é", "x" * 10, "  a  1 b "]
    text, bucket, count, has = langid.trigrams(texts)
    for i, t in enumerate(texts):
        _, b, c, h = langid.trigrams([t])
        assert (bucket[text == i] == b).all() and (count[text == i] == c).all() and has[i] == h[0]


def test_lang_source_and_id_are_no_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    swapped = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = sorted(langid.predict(docs, model).collect())
    assert a == sorted(langid.predict(swapped, model).collect())


def test_odd_rows(spark, odd, nothing):
    model = langid.fit(odd)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert len(langid.predict(odd, model).collect()) == odd.count()
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 6, 8))
    assert got[7].lang_pred in model.languages and got[None].held_out is False
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 5, 7}
    empty = langid.fit(nothing)
    assert langid.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert np.isfinite(model.like).all()

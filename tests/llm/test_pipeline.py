import corpus_pipeline
from pictora.llm import decontaminate, langid, mixing, shards


def test_stages_in_order_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_run_against_brute_force(spark, sf_dir):
    from test_near_copies import brute_near

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    keep = {}
    for d, r in rows.items():
        (lang,), (score,) = model.predict([r.text or ""])
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE:
            keep[d] = r
    least = set(brute_near({d: r.text for d, r in keep.items()}).values())
    keep = {d: keep[d] for d in sorted(least)}
    frame = spark.createDataFrame([tuple(r) for r in keep.values()], docs.schema)
    leaked = {r.doc_id for r in decontaminate.overlaps(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    text = {i.item_id: i.text for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {d for d, r in keep.items() if any(t in r.text for t in text.values())} <= leaked
    frame = frame.where(~frame.doc_id.isin(list(leaked)))
    mixed = {x.doc_id for x in mixing.select(frame, share=corpus_pipeline.SHARE, max_epochs=1).where("epochs > 0").collect()}
    frame = spark.createDataFrame([r for r in frame.collect() if r.doc_id in mixed], docs.schema)
    want = sorted(shards.descend(frame, "doc_id", shards.topology(40)).collect())
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_odd_rows_in_every_stage(spark, odd, nothing, sf_dir):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage; a row with a null id is a document like any other."""
    want = {"language_id": {1, 2, None, 5, 7}, "near_dedup": {1, 3, 5, 7, 8}, "decontamination": {1, 2, 3, 4, 5, 6, 7, 8, None}, "mixing": None, "sharding": {1, 2, 3, 4, 5, 6, 7, 8, None}}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd, sf_dir)
        assert [c for c in kept.columns if c in odd.columns] == odd.columns or name == "sharding", name
        ids = {r.doc_id for r in kept.collect()}
        assert ids == want[name] if want[name] else ids < {1, 2, 3, 4, 5, 6, 7, 8, None}, (name, ids)
        assert stage(spark, nothing, sf_dir).count() == 0, name


def test_workers_give_back_memory_after_each_task(spark):
    """The rows are unchanged, and what a task freed is the system's again before the worker waits for another."""
    import os
    import re

    import numpy as np
    import pyarrow as pa

    from pictora.llm.common import lean

    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{os.getpid()}/status").read())[1]) / 1024

    def hungry(batches):
        for batch in batches:
            before = held()
            parts = [np.ones(10_000) for _ in range(2000)]  # 160 MB in pieces that the heap keeps
            pin = [np.ones(100) for _ in range(10)]
            del parts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([before] * batch.num_rows), pa.array([len(pin)] * batch.num_rows)], ["id", "mb", "n"])

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3])], ["id"])
    start = held()
    assert [b.column(0).to_pylist() for b in lean(hungry)(iter([batch]))] == [[1, 2, 3]]
    assert held() - start < 60
    rows = spark.range(0, 100, 1, 1).mapInArrow(lean(hungry), "id long, mb double, n long").collect()
    assert [r.id for r in rows] == list(range(100))

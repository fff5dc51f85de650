import random

from pictora.llm import queries, warc


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(7)
    for n in (1, 2, 3, 5, 8, 13):
        runs = [sorted(((rng.choice("abc"), str(rng.randrange(9)), rng.randrange(99), "", None, "", 0, f"r{r}", k, 0) for k in range(rng.randrange(20))), key=warc._order) for r in range(n)]
        assert list(warc.LoserTree(runs)) == sorted((e for r in runs for e in r), key=warc._order)
    assert list(warc.LoserTree([])) == []


def test_archives_read_back_and_are_ordered(spark):
    nasty = ["", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb", "é" * 1000, "same", "same", "x\r\n\r\n", "\n", "same"]
    pages = spark.createDataFrame([(i, f"http://www.b{i % 3}.org/x?b=1&a={i}" if i % 4 else None, h) for i, h in enumerate(nasty)], "page_id long, url string, html string")
    path = warc.archive_path(spark)
    warc.write(pages.repartition(3), path, records_per_archive=2)
    rows = warc.index(spark, path, slice_entries=2).collect()
    assert [warc._order(r) for r in rows] == sorted(warc._order(r) for r in rows)
    got = {r.page_id: r for r in rows}
    first = {}
    for i, h in enumerate(nasty):
        body = (h or "").encode()
        f = first.setdefault(body, i)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(body), warc.digest(body), "response" if f == i else "revisit", None if f == i else f)
    # Offsets and lengths cut single records out of the archives.
    files = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(path + "/part-*").collect()}
    for r in rows:
        head, body, *_ = next(warc.parse(files[r.archive][r.offset : r.offset + r.length]))
        assert head["warc-record-id"] == f"<{warc.URN}{r.page_id}>"
        assert body == ((nasty[r.page_id] or "").encode() if r.record_type == "response" else b"")


def test_a_threshold_leaves_small_payloads_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = warc.archive_path(spark)
    warc.write(pages, path, least_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.index(spark, path).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (2, "http://[bad", "x", 1), (2, "http://[bad", "x", 1), (3, "a b\r\nInjected: y", "", 1)], "page_id long, url string, html string, digest int")
    path = warc.archive_path(spark)
    warc.write(pages, path)
    rows = warc.index(spark, path).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [(0, "revisit", 3), (2, "response", None), (2, "response", None), (3, "response", None)]
    path = warc.archive_path(spark)
    warc.write(pages.where("false"), path)
    assert warc.index(spark, path).count() == 0


def test_query_holds_every_page(spark, sf_dir):
    assert queries.op10_warc(spark, sf_dir).select("page_id").distinct().count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()

from collections import Counter

from pyspark.sql import functions as F

from pictora.llm import shards


def test_key_law_slots_and_growth(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = shards.shard(docs).collect()
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(40)) and max(count.values()) < 1.3 * 500 and min(count.values()) > 0.7 * 500
    for s, n in count.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {40} and 0.7 < len(moved) / (20_000 / 41) < 1.3
    part = {r.doc_id: r.shard for r in shards.shard(docs.where("doc_id % 7 = 0")).collect()}
    assert part == {r.doc_id: r.shard for r in rows if r.doc_id % 7 == 0}


def test_slots_over_many_buckets(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(16).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), (F.col("id") % 2).cast("int").alias("shard"))
    got = shards.slots(rows, bucket_rows=50).groupBy("shard").agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2499, 2500), (1, 0, 2499, 2500)]


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"))
    old = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]]
    new = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 3.0], [1.0, 1.0]]]
    rows = shards.descend(shards.descend(keys, "doc_id", old, "a"), "doc_id", new, "b").where("a <> b").collect()
    assert rows
    region = lambda s: s // 4
    for r in rows:
        assert region(r.b) == 1  # rows only come into the region that grew
        if region(r.a) == 1:
            assert r.b // 2 == 2  # within it, into the rack that grew
            if r.a // 2 == 2:
                assert r.b == 5  # within that, to the shard that grew


def test_weights_are_shares(spark):
    keys = spark.range(8000).select(F.col("id").alias("doc_id"))
    n = Counter(r.shard for r in shards.descend(keys, "doc_id", [[[3.0, 1.0]], [[4.0]]]).collect())
    assert abs(n[0] - 3000) < 250 and abs(n[1] - 1000) < 200 and abs(n[2] - 4000) < 250


def test_odd_rows(spark, odd, nothing):
    import zlib

    rows = shards.shard(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(16, 0)}
    one, two = (r for r in rows if r.doc_id == 1)
    assert one.shard == two.shard and one.slot != two.slot
    assert next(r for r in rows if r.doc_id == 7).text_crc32 == zlib.crc32(b"zwei")
    assert shards.shard(nothing).count() == 0


def test_one_more_shard_takes_rows_only_into_itself_at_any_number(spark):
    """From n to n + 1 and n + 2 shards, for layouts that began with n: rows move into the new ones only."""
    keys = spark.range(2000).select(F.col("id").alias("doc_id")).coalesce(4)
    for n in (1, 2, 7, 19, 20, 21, 38, 39, 40, 41, 59, 60):
        now = shards.descend(keys, "doc_id", shards.topology(n), "now")
        more = shards.descend(now, "doc_id", shards.topology(n + 1, n), "more")
        last = shards.descend(more, "doc_id", shards.topology(n + 2, n), "last")
        moved = last.where("(now <> more and more <> %d) or (more <> last and last <> %d)" % (n, n + 1))
        assert moved.isEmpty(), n
        assert last.where(f"more = {n}").count() > 0

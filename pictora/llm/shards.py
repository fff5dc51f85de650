"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

A topology is a list of regions, each a list of racks, each a list of shard weights. A row descends it by its key: at each
level every child draws a hash of (key, child) and the child with the least ``-ln(u) / weight`` wins, so children win in
proportion to their weights, and if a child's weight changes rows only move to or from that child. What moves is thus
confined to the subtrees whose weights change. A shard that is added becomes a region of its own, so it takes rows from
everywhere, in proportion to its weight, and no row moves between the others, as long as the topology keeps its base: the law is ``key``.

Slots number a shard's rows without gaps. Rows are dealt by hash into buckets small enough for one task, numbered within the
bucket, and moved up by the sizes of the buckets before; no task ever sorts a whole shard. Slots follow the ids in tables of one bucket a shard, and
the buckets' hashes first in larger ones.

Defined cases: a null text has size 16 and checksum 0; a null key is hashed as a key of its own; rows with equal keys share a
shard and have separate slots; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictora.llm.common import durable

Topology = list[list[list[float]]]

OVERHEAD = 16
#: Rows of a bucket within which slots are numbered, on average.
BUCKET_ROWS = 50_000
HEX = 12


def topology(shards: int, base: int | None = None, regions: int = 2, racks: int = 4, per_rack: int = 5) -> Topology:
    """Of the first ``base`` shards (all, if not given) full regions of racks of equal shards as far as they go; each other shard is a region of its own.

    Keep the base that a store began with as it grows: then the shards beyond it stay regions of their own, and no number of shards moves rows
    between the others.
    """
    full = min(regions, min(shards, shards if base is None else base) // (racks * per_rack))
    tree: Topology = [[[1.0] * per_rack for _ in range(racks)] for _ in range(full)]
    return tree + [[[1.0]] for _ in range(shards - full * racks * per_rack)]


def _draw(key: str, node: str, weight: str) -> str:
    """SQL for one child's draw: an exponential variable with the weight as its rate, from 48 bits of a digest."""
    bits = f"cast(conv(substr(md5(concat({key}, '/', {node})), 1, {HEX}), 16, 10) as double)"
    return f"-ln(({bits} + 0.5D) / {16**HEX}D) / {weight}"


def _winner(key: str, children: str) -> str:
    """SQL for the winning child of an array of (node, weight, at)."""
    return f"array_min(transform({children}, c -> struct({_draw(key, 'c.node', 'c.weight')} as draw, c.at as at))).at"


def _children(rows: list[tuple[str, float, int]]) -> str:
    return "array(" + ", ".join(f"named_struct('node', '{n}', 'weight', {w!r}D, 'at', {a})" for n, w, a in rows if w > 0) + ")"


def descend(rows: DataFrame, key: str, tree: Topology, to: str = "shard") -> DataFrame:
    """``rows`` with the shard that each key descends to, as column ``to``; a column of that name is replaced."""
    number, regions, racks, leaves = 0, [], [], []
    for r, region in enumerate(tree):
        regions.append((f"r{r}", float(sum(map(sum, region))), r))
        of_region = []
        for k, rack in enumerate(region):
            of_region.append((f"r{r}k{k}", float(sum(rack)), k))
            of_rack = []
            for s, weight in enumerate(rack):
                of_rack.append((f"r{r}k{k}s{s}", float(weight), number))
                number += 1
            leaves.append((r, k, _children(of_rack)))
        racks.append(_children(of_region))
    known = f"coalesce(cast({key} as string), '\\\\N')"
    out = rows.withColumn("__key", F.expr(known)).withColumn("__region", F.expr(_winner("__key", _children(regions))))
    out = out.withColumn("__rack", F.expr(_winner("__key", f"element_at(array({', '.join(racks)}), __region + 1)")))
    widest = max(len(region) for region in tree)
    empty = "cast(array() as array<struct<node:string,weight:double,at:int>>)"
    table = {(r, k): x for r, k, x in leaves}
    grid = ", ".join(table.get((r, k), empty) for r in range(len(tree)) for k in range(widest))
    out = out.withColumn(to, F.expr(_winner("__key", f"element_at(array({grid}), __region * {widest} + __rack + 1)")).cast("int"))
    return out.drop("__key", "__region", "__rack")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32)`` of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def slots(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows(doc_id, size, text_crc32, shard, ...)`` with ``slot``, gapless from 0 in each shard."""
    counted = rows.agg(F.count("*").alias("n"), F.max("shard").alias("top")).first()
    buckets = max(1, -(-counted.n // (bucket_rows * ((counted.top or 0) + 1))))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("within", F.row_number().over(within))
    joined = numbered.join(sums, (numbered.shard == sums.of_shard) & (numbered.bucket == sums.of_bucket))
    return joined.withColumn("slot", F.col("before") + F.col("within") - 1).drop("of_shard", "of_bucket", "before", "within", "bucket")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``; grown_shard: with one shard more."""
    rows = descend(descend(sized(docs), "doc_id", topology(shards)), "doc_id", topology(shards + 1, shards), "grown_shard")
    return slots(durable(rows)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

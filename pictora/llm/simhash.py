"""SimHash near-duplicates: 64-bit fingerprints linked by a Gray-order hierarchical index.

The text is lower-cased (A-Z), cut into words and 3-word shingles; a fingerprint bit is set if it is set in over half of
the shingles' XXH64 values. Fingerprints with at most ``distance`` differing bits are linked and the links closed
transitively.

How the links are found. Equal fingerprints are one node, so copies cost one row. The 64 bits are cut into
``distance + 4`` blocks: two fingerprints within the distance agree on all blocks but ``distance`` of them, so each
fingerprint is dealt once for every choice of agreeing blocks and meets all its partners. With six blocks a bucket's
members differ in at most 22 bits, so a bucket holds 2**22 fingerprints at the very most, whatever the skew. In a bucket the
fingerprints stand in Gray order; runs of ``FANOUT`` neighbours share a parent that holds the bits common to all of them
(mask and pattern) and each child keeps only the bits its parent has not factored out. A search adds up the differences
on the way down and leaves a whole group once the sum passes the distance. A bucket gives back a spanning forest of
what it linked, never pairs, and a distributed contraction joins the forests.

Defined cases: null text or a text without words has fingerprint zero and is linked like any other; fewer than three words
are one shingle; repeated rows and ids are separate rows of one class; a class of null ids only has a null component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictora.llm.common import components, durable, lean, only

FANOUT = 8
BLOCK = 1 << 15
#: Fingerprints gathered before a search, so that small buckets are searched together.
CHUNK = 1 << 17


def majority(values: np.ndarray) -> int:
    """The bits that over half of the 64-bit values have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined, hashes = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return hashes(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    values = np.array([hashes(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64)
    return majority(values)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for each row, ``fp`` a signed long holding the 64 bits."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(distance: int) -> list[int]:
    """For each choice of agreeing blocks, the mask of their bits, as signed longs."""
    n = distance + 4
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(blocks, n - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


class GrayIndex:
    """Hierarchical index over fingerprints that stand bucket by bucket, in Gray order within a bucket."""

    def __init__(self, prints: np.ndarray, bucket: np.ndarray):
        self.prints, last = prints, np.arange(len(prints))
        levels = [{"all": prints, "any": prints, "last": last}]
        first_child: list[np.ndarray] = []
        count: list[np.ndarray] = []
        while True:
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            if len(start) == len(bucket):
                break
            place = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
            first = np.flatnonzero(place % FANOUT == 0)
            below = levels[-1]
            first_child.append(first)
            count.append(np.diff(np.r_[first, len(bucket)]))
            levels.append({"all": np.bitwise_and.reduceat(below["all"], first), "any": np.bitwise_or.reduceat(below["any"], first), "last": below["last"][np.r_[first[1:], len(bucket)] - 1]})
            bucket = bucket[first]
        self.first_child, self.count = first_child, count
        shared = [~(x["all"] ^ x["any"]) for x in levels]
        self.pattern, self.last = [x["all"] for x in levels], [x["last"] for x in levels]
        self.own = [s & ~np.repeat(up, c) for s, up, c in zip(shared, shared[1:], count)] + [shared[-1]]
        self.root = np.repeat(np.arange(len(bucket)), np.diff(np.r_[-1, self.last[-1]]))

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of one bucket with at most ``distance`` differing bits, in blocks."""
        for at in range(0, len(self.prints), BLOCK):
            query = np.arange(at, min(at + BLOCK, len(self.prints)))
            yield from self._descend(query, self.root[query], np.zeros(len(query), np.uint8), len(self.own) - 1, distance)

    def _descend(self, query: np.ndarray, node: np.ndarray, differ: np.ndarray, level: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        differ = differ + np.bitwise_count((self.prints[query] ^ self.pattern[level][node]) & self.own[level][node])
        stays = (differ <= distance) & (self.last[level][node] > query)
        query, node, differ = query[stays], node[stays], differ[stays]
        if not level:
            if len(query):
                yield query, node
            return
        for at in range(0, len(query), BLOCK):
            q, x, d = query[at : at + BLOCK], node[at : at + BLOCK], differ[at : at + BLOCK]
            n = self.count[level - 1][x]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield from self._descend(np.repeat(q, n), np.repeat(self.first_child[level - 1][x], n) + offset, np.repeat(d, n), level - 1, distance)


def _forest(prints: np.ndarray, bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (print, root of its local component) of what the index links."""
    label = np.arange(len(prints))
    for i, j in GrayIndex(prints, bucket).pairs(distance):
        while True:
            a, b = label[i], label[j]
            if not (apart := a != b).any():
                break
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def _linker(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            choice, key, prints = (np.concatenate(x) for x in zip(*held))
            new = np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]
            bucket = np.cumsum(new)
            end = len(bucket) if final else int(np.flatnonzero(new)[-1])
            held, size = ([] if final else [(choice[end:], key[end:], prints[end:])]), len(bucket) - end
            many = np.bincount(bucket[:end], minlength=1)[bucket[:end]] > 1
            if many.any():
                u, v = _forest(prints[:end][many].view(np.uint64), bucket[:end][many], distance)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        limit = CHUNK
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size >= limit:
                yield from flush(False)
                limit = max(CHUNK, 2 * size)
        if size:
            yield from flush(True)

    return link


def gray_rank(prints):
    """Rank of a column of fingerprints in the reflected Gray code, as a column."""
    for s in (1, 2, 4, 8, 16, 32):
        prints = prints.bitwiseXOR(F.shiftrightunsigned(prints, s))
    return prints


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Spanning edges ``(u, v)`` among the distinct fingerprints ``prints(fp)`` within ``distance`` bits."""
    masks = block_masks(distance)
    dealt = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"))
    dealt = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key", gray_rank(F.col("fp")))
    return dealt.select("choice", "key", "fp").mapInArrow(lean(_linker(distance)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``; component_id is the class's smallest doc_id."""
    rows = durable(fingerprints(docs))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(classes, "root").select(F.col("fp").alias("named_fp"), "component_id")
    return rows.join(named, rows.fp == named.named_fp).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, distance: int = 2) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, all columns kept: that of its smallest doc_id.

    Rows under one doc_id are one document, of which the row with the smallest text stays; the sort for that is only
    planned where an id does occur twice.
    """
    found = durable(near_duplicates(docs, distance))
    kept = only(docs, found.where("not doc_id <=> component_id"), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return kept.withColumn("__row_of_id", first).where("__row_of_id = 1").drop("__row_of_id")

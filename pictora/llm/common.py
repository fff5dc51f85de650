"""What the corpus operators share: durable intermediate results, connected components, row filters."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than the six ASCII white-space characters; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: the session's ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (local tests) is a folder made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pictora-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (folder or known.get()).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: compute ``df`` once into the shared folder, from where it survives lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same for wide or long results: a Parquet table in the shared folder, which packs columns tighter than a checkpoint."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one computation, in a folder of their own in the shared folder, each removed once nothing reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch(spark)}/tables-{uuid.uuid4().hex}"

    def name(self) -> str:
        return uuid.uuid4().hex

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Remove the named tables, or all; what was computed from them has to be written or checkpointed before."""
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            remove(self.spark, path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that the executors remove the shuffle files of what is computed and forgotten."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whichever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and, where the C library has it, the heap's free pages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, so that a worker that waits for its next task doesn't hold what the last one needed."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


#: Edges of 16 bytes that one task joins.
LOCAL_EDGES = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all the edges, with the smallest node it is connected with."""
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*[[c.to_numpy() for c in b.columns] for b in batches])) if (batches := list(batches)) else (np.empty(0, np.int64),) * 2
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    i, j, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (apart := root[i] != root[j]).any():
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph ``edges(u, v)`` as ``(node, root)``, root the smallest node.

    Up to ``LOCAL_EDGES`` counted edges, a bounded number, are joined in one task. For more, large-star and small-star contraction
    alternate until the edges no longer change. A star's hub meets its edges in a sort-merge join, which adaptive execution can split, and
    minima are aggregated map-side first. Nothing but counts and a checksum reaches the driver. Null nodes and self-loops are ignored; an empty input gives an empty result.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now, before = durable(now), None
    if now.count() <= LOCAL_EDGES:
        return durable(now.coalesce(1).mapInArrow(lean(_joined), "node long, root long"))
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub")
        small = large.join(low, large.u == low.hub)
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("hub").alias("u"), F.col("m").alias("v")))
        now = durable(small.distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


#: Rows of a narrow side that may be broadcast: ids and digests of at most 64 bytes, so at most 13 MB.
BROADCAST_ROWS = 200_000


def small(side: DataFrame) -> DataFrame:
    """``side`` (already computed, narrow), marked for a broadcast if its counted rows allow it; else it meets the other side by a shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``left_semi``) or is not (``left_anti``) in ``ids(doc_id)``; a null id equals a null id."""
    wanted = small(durable(ids.select(F.col("doc_id").alias("__wanted_id")).distinct()))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__wanted_id"]), how)

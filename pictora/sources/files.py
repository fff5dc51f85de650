"""Housekeeping on any file system Hadoop knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str, folders: bool) -> list[str]:
    p, fs = _at(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() == folders and not s.getPath().getName().startswith("_"))


def files(spark: SparkSession, path: str) -> list[str]:
    return _list(spark, path, False)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Sub-folders, for instance one for each dataset of a root."""
    return _list(spark, path, True)


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def make(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file or a folder."""
    a, from_fs = _at(spark, source)
    b, to_fs = _at(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, b, False, spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source: str, target: str) -> str:
    """Rename, with the first free number behind the name if the target exists."""
    p, fs = _at(spark, source)
    found, n = target, 0
    while exists(spark, found):
        n += 1
        found = f"{target}-{n}"
    if not fs.rename(p, _at(spark, found)[0]):
        raise OSError(f"{source} can't be renamed to {found}")
    return found

"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from pictora import catalog

TABLES = ("documents", "embeddings", "labels")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query_against_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    result = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(r[columns.index(n)] for n in names) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert len(got) == len(want) and (got or name == "empty_clusters")
    assert all(close(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_other_queries_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """The smallest tables with captions that are null, empty, blank, or hold rare white space."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd = spark.createDataFrame(list(enumerate([None, "", " \t ", "a\x0bb c\x0cd", "\x1cq r\x85s\xa0t", "one"])), "doc_id long, odd string")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").join(odd, "doc_id", "left")
    texts.withColumn("text", F.when(F.col("doc_id") < 6, F.col("odd")).otherwise(F.col("text"))).drop("odd").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["doc_length", "modality_documents"])
def test_odd_captions_against_sql(spark, odd_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{odd_dir}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, odd_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

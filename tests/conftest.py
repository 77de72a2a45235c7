import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def same_rows(df, relation):
    """Whether a DataFrame and a DuckDB relation have the same columns and rows, in any order."""
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
    assert a == b
    return len(a)

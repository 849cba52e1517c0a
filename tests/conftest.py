import os
import sys
from pathlib import Path

import pandas
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    """A value as text, equal on both engines."""
    if pandas.isna(value):
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def same_rows(df, frame) -> None:
    """A Spark result has the columns and rows of a pandas frame, in any order."""
    got = df.toPandas()
    assert sorted(got.columns) == sorted(frame.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted(tuple(map(plain, r)) for r in x[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(frame)

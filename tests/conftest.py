import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Checks that a query and its SQL give the same rows."""

    def norm(df):
        df = df[sorted(df.columns)].astype(str)
        return df.sort_values([*df.columns]).reset_index(drop=True)

    def check(query, sql):
        got, want = norm(query(spark, DATA).toPandas()), norm(duck.execute(sql).df())
        assert [*got.columns] == [*want.columns]
        assert len(got) == len(want)
        assert got.equals(want), got.compare(want).head()

    return check

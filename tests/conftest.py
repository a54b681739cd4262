import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same_rows(spark_df, duck_df):
    import pandas as pd

    a, b = spark_df.toPandas(), duck_df
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    text = lambda x: None if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    rows = lambda d: sorted((tuple(text(x) for x in r) for r in d[cols].itertuples(index=False)), key=str)
    assert rows(a) == rows(b)

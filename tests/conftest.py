import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(plain, x))
    return bytes(x) if isinstance(x, bytearray) else x


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Run a query and its SQL over the smallest tables and compare columns and rows."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, SMALL)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        names = list(rel.columns)
        assert sorted(names) == cols
        mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        assert mine == theirs

    return check

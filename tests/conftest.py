import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    return path


@pytest.fixture(scope="session")
def same_rows():
    """Compares rows of a Spark frame with those of SQL in DuckDB, columns by name, order aside."""
    import duckdb

    def compare(found, sql, folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            at = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
        a, b = found.toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        key = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
        x, y = key(a), key(b)
        assert len(x) == len(y)
        assert x.equals(y)

    return compare

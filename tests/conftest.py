from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the same tables, each time in a fresh connection."""
    import duckdb

    def run(sql: str):
        c = duckdb.connect()
        for t in sorted(os.listdir(DATA)):
            c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{t}')")
        cur = c.execute(sql)
        names = [x[0] for x in cur.description]
        return names, cur.fetchall()

    return run


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Asserts that a query and its SQL give the same rows, whatever the order of rows and columns."""

    def check(query, sql):
        df = query(spark, sf_dir)
        names, rows = duck(sql)
        cols = sorted(df.columns)
        assert cols == sorted(names)
        mine = sorted(repr([r[c] for c in cols]) for r in df.collect())
        at = [names.index(c) for c in cols]
        assert mine == sorted(repr([r[i] for i in at]) for r in rows)

    return check

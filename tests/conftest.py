import os
import sys
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"file://{base}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _told(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(map(_told, r)) for r in df.select(*columns).collect())


def sql_rows(sql, views):
    """views: name -> a DuckDB relation expression."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name, source in views.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM {source}")
    c.execute(f"CREATE TABLE found AS {sql}")
    columns = sorted(r[0] for r in c.execute("DESCRIBE found").fetchall())
    return columns, Counter(tuple(map(_told, r)) for r in c.execute(f"SELECT {', '.join(columns)} FROM found").fetchall())


@pytest.fixture(scope="session")
def same(spark):
    """same(query, sql, sf_dir): the Spark result and DuckDB's are one multiset."""

    def run(query, sql, sf_dir=SF):
        got, want = rows_of(query(spark, sf_dir)), sql_rows(sql, {t: f"'{sf_dir}/{t}.parquet'" for t in TABLES if os.path.exists(f"{sf_dir}/{t}.parquet")})
        assert got[0] == want[0]
        assert got[1] == want[1], f"only Spark {list((got[1] - want[1]).items())[:3]}, only SQL {list((want[1] - got[1]).items())[:3]}"

    return run

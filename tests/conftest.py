import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('work')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def same_as_oracle(spark, sf_dir):
    """Run a query and its SQL and compare their rows."""
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def plain(v):
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        return round(v, 9) if isinstance(v, float) else v

    def check(query, sql):
        got = query(spark, sf_dir)
        cols = sorted(got.columns)
        want = con.sql(sql)
        assert cols == sorted(want.columns)
        at = [want.columns.index(c) for c in cols]
        a = [repr([plain(r[c]) for c in cols]) for r in got.collect()]
        b = [repr([plain(r[i]) for i in at]) for r in want.fetchall()]
        if "ORDER BY" not in sql.rsplit(")", 1)[-1]:  # else the rows' order counts
            a, b = sorted(a), sorted(b)
        assert a == b

    return check

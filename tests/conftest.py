from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TESSELLE_TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame has the rows of a DuckDB query, columns by name."""

    def text(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    def rows(data, columns):
        at = [columns.index(c) for c in sorted(columns)]
        return sorted((tuple(text(r[i]) for i in at) for r in data), key=str)

    def check(df, con, sql):
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        assert rows([tuple(r) for r in df.collect()], df.columns) == rows(result.fetchall(), names)

    return check

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tiny_model(tmp_path_factory):
    from gavel.operators.tiny import write_tiny_model

    return write_tiny_model(str(tmp_path_factory.mktemp("model") / "tiny.gguf"))


def by_sql(sf_dir, sql):
    """The rows of a query in DuckDB over the tables of a folder, as sorted strings by column."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c.execute(sql).df()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    for c in cols:  # whole numbers with nulls are floats on one side
        kinds = [str(x[c].dtype).lower() for x in (a, b)]
        if any(k.startswith("int") for k in kinds) and any(k.startswith("float") for k in kinds):
            a, b = a.astype({c: "Int64"}), b.astype({c: "Int64"})
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    diff = (a != b).any(axis=1)
    assert not diff.any(), f"{a[diff].head()}\n{b[diff].head()}"

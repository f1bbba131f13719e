"""Tables between jobs: written to the folder that driver and executors share, so that lineage is short and lost executors cost a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is named and all runs here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gavel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gavel-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has no more rows than the bound; it is counted no further."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def small_or_not(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if its counted rows are within the bound; else the join is shuffled."""
    return F.broadcast(df) if counted_small(df, rows) else df

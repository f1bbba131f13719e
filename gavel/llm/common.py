"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one slice that a Python worker holds in expanded form.
SLICE_ROWS = 512
#: UTF-8 bytes of one slice; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Spark's bound on the bytes of a batch that goes to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A table is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where none is named and all runs on this machine (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gavel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, lost executors cost nothing.

    A result reads such tables when it is computed, so they stay until clear_stored() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gavel-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at SLICE_BYTES, unless the user set their size: Spark's 64 MB would hold a whole split's texts at once, twice in the JVM while they grow, and again in the worker."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


def clear_stored(spark: SparkSession) -> None:
    """Remove all tables that stored() has written to the shared folder; call it when results have been read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "gavel-*")) or ():
        files.delete(found.getPath(), True)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if its counted rows are within the bound, else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds at most SLICE_ROWS rows and about SLICE_BYTES of text."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over text slices; make() runs once in each task and returns the slice function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in slices(batches, text):
            out = f(part)
            if out is not None and out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch; schema as mapInArrow takes it, of plain types."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3; 1 is held out from every training set."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id="doc_id"):
    return F.coalesce(fold(doc_id) == 1, F.lit(False))

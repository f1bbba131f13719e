"""Documents from whole files, and the models of a folder, as Spark scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, text): a row for each file below path whose name fits the pattern, read whole; the id is its path. Bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.make_valid_utf8("value").alias("text"))


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes) of a folder's models, the smallest first, without projectors; only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gguf").load(folder).select("path", F.col("length").alias("bytes"))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")
    return named.filter(~F.contains(F.lower("name"), F.lit("mmproj"))).orderBy("bytes", "name")

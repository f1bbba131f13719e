"""File formats of models, as Spark data sources."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    from gavel.sources.gguf import GgufSource
    from gavel.sources.safetensors import SafetensorsSource

    spark.dataSource.register(GgufSource)
    spark.dataSource.register(SafetensorsSource)

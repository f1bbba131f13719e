"""Moderation of a stream: append-only, stateless, so there is neither a watermark nor state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavel.operators.moderate import moderate


def moderate_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, model: str, schema: str = "doc_id long, text string", threshold: float = 0.5, once: bool = True):
    """Read new Parquet files of source, moderate them, append Parquet to sink; returns the query."""
    docs = spark.readStream.schema(schema).parquet(source)
    out: DataFrame = moderate(docs, model, threshold=threshold)
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

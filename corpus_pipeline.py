"""Corpus pipeline over the documents table: quality, near duplicates, repeats, contamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavel.llm.common import stored, table
from gavel.llm.stages import STAGES

#: A classifier's trees, suffix arrays and Viterbi paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; each one's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

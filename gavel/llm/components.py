"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import BROADCAST_ROWS, stored

#: Edges of one task where a counted table is small; one with more than half of BROADCAST_ROWS is shuffled.
TASK_EDGES = 10_000


def _tasks(n: int) -> int:
    """Tasks for so many counted edges, whatever the number of shuffle partitions; 0 if they are too many to be broadcast."""
    return max(4, -(-n // TASK_EDGES)) if 2 * n <= BROADCAST_ROWS else 0


def _few(df: DataFrame, tasks: int) -> DataFrame:
    return df.coalesce(tasks) if tasks else df


def _step(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """Each node hands its larger (or, in a small star, its smaller) neighbours the least id it knows."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = _few(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tasks)
    joined = near.join(F.broadcast(least) if tasks else least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = out.filter("a != b")
    return _few(out.distinct(), tasks) if small else out  # a small star follows each large one


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in edges (a, b): the smallest id that links reach. Nothing but counts comes to the driver."""
    tasks = _tasks(edges.count())
    edges = stored(_few(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b").distinct(), tasks))
    before = None
    while True:
        edges = stored(_step(_step(edges, False, tasks), True, tasks))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min("b"), F.max("a")).first())
        if now == before or not now[0]:
            break
        before, tasks = now, _tasks(now[0])
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(_few(edges.select(F.col("b"), F.col("b")).distinct(), tasks))

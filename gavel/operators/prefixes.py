"""The longest prefix that a sequence shares with any sequence of an index, by a search over hashed prefixes.

A search in base RADIX over lengths: all sequences start at length 0; in each round a sequence at length n asks for its prefixes of n + d * step
tokens, d from 1 to RADIX - 1, and goes on from the longest that the index has. The index offers prefixes only from lengths where an asking sequence
with the same prefix stands, so a round's join has RADIX - 1 rows for each sequence that is still in it, each a length and two hashes, never a sequence.
Rounds are the digits of the greatest length of the index; what lies beyond that is cut off before the search, as nothing can share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.tables import small_or_not, stored

RADIX = 16


def _length(df: DataFrame, c: str) -> Column:
    return F.size(c) if dict(df.dtypes)[c].startswith("array") else F.char_length(c)


def _start(df: DataFrame, c: str, n: Column) -> Column:
    """The first n tokens: of an array, or the characters of a text."""
    return F.slice(c, F.lit(1), n) if dict(df.dtypes)[c].startswith("array") else F.substring(c, F.lit(1), n)


def _asked(df: DataFrame, step: int) -> DataFrame:
    """(row, n, c, h, g): the prefixes of c tokens that each row, now at length n, can go on to."""
    further = F.explode(F.transform(F.sequence(F.lit(1), F.lit(RADIX - 1)), lambda d: F.col("n") + d * step))
    each = df.select("row", "tokens", "size", "n", further.alias("c")).filter("c <= size")
    start = _start(each, "tokens", F.col("c"))
    return each.select("row", "n", F.col("c").cast("int").alias("c"), F.xxhash64(start).alias("h"), F.hash(start, F.lit(7)).alias("g"))


def longest_shared_prefix(asking: DataFrame, key: str, tokens: str, index: DataFrame, index_tokens: str) -> DataFrame:
    """(key, shared): tokens that each row of asking shares with the start of some row of index, at most. Null tokens share null, empty ones and an empty index 0; rows of equal keys stay rows of their own."""
    own = index.select(F.col(index_tokens).alias("tokens")).filter("tokens is not null").distinct()
    own = stored(own.withColumn("size", _length(own, "tokens")).withColumn("row", F.monotonically_increasing_id()))
    most = own.agg(F.max("size")).first()[0] or 0
    rows = asking.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    rows = rows.withColumn("tokens", _start(rows, "tokens", F.lit(most)))
    rows = stored(rows.withColumn("size", _length(rows, "tokens")))
    here = rows.filter("tokens is not null").select("row", "tokens", "size", F.lit(0).alias("n"))
    there = own.select("row", "tokens", "size", F.lit(0).alias("n"))
    step = 1
    while step * RADIX <= most:
        step *= RADIX
    while step and most:
        told = _asked(there, step)
        offers = stored(told.select("c", "h", "g").distinct())
        found = _asked(here, step).join(small_or_not(offers.withColumn("hit", F.lit(True))), ["c", "h", "g"])
        reached = stored(found.groupBy("row").agg(F.max(F.struct("c", "h", "g")).alias("to")))
        moved = here.join(reached, "row", "left").select("row", "tokens", "size", F.coalesce("to.c", "n").alias("n"))
        here = stored(moved)
        if step > 1:
            # the index goes on from the lengths at which someone stands with the same prefix: those reached now, and those where someone stayed
            live = reached.select("to.c", "to.h", "to.g").distinct()
            ahead = told.join(small_or_not(live), ["c", "h", "g"], "left_semi").select("row", F.col("c").alias("n"))
            stayed = here.join(reached, "row", "left_anti").select("n").distinct()
            behind = there.select("row", "n").join(small_or_not(stayed), "n", "left_semi")
            there = stored(own.join(ahead.unionByName(behind).distinct(), "row"))
        step //= RADIX
    return rows.join(here.select("row", "n"), "row", "left").select(F.col("key").alias(key), F.col("n").cast("long").alias("shared"))

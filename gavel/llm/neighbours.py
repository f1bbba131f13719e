"""Operator 5: approximate nearest neighbours by adaptive dimension scan in probed lists.

Vectors are clustered into lists around centroids that k-means fits on a
bounded sample (``SAMPLE_ROWS``); every vector is indexed. A query probes the
lists of its nearest centroids, as many as sampled queries need to find a
target share of their true neighbours. In a list, candidates are held rotated by a
random orthogonal matrix in blocks of columns; after each block a hypothesis
test compares the partial distance, scaled to all dimensions, with the best
distances so far, and abandons candidates that are too far with high
confidence. Survivors are ranked by the exact Euclidean distance of the
original vectors in double precision.

Equal vectors are one candidate that carries its smallest TOP + 1 ids (no more
can be among the nearest of any query), gathered in two steps so that a hot
vector is never in one task; equal queries are searched once. Long lists are
cut into blocks of candidates and of queries.

Queries that found fewer than TOP candidates search every list, so a query gets
fewer only if there are no more. Defined results: vectors that are null, empty, zero, hold a
null or non-finite component, or differ from the commonest length take no
part, and a table without others has no rows; ties go to the smaller id; repeated ids count once per row; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import stored

TOP = 10
SAMPLE_ROWS = 16_384
LISTS = 1_024
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 512
#: Width of a column block, and how many standard errors a candidate gets before it is abandoned.
COLUMNS, SURE = 16, 2.1


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.transform(embedding, lambda x: x.cast("double"))
    df = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    common = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.filter(F.size("v") == (common[0]["n"] if common else 0))


def distinct_vectors(df: DataFrame, every: int) -> DataFrame:
    """A row for each distinct vector: its smallest ids, the first as key, and whether any of its ids is a query."""
    least = lambda lists: F.slice(F.array_sort(lists), 1, TOP + 1)
    merged = lambda: (least(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("asks").alias("asks"))

    def in_task(batches):  # the ids of equal vectors of a batch, at most TOP + 1 of each
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.lexsort((ids, *x.T[::-1]))
            ids, x = ids[order], x[order]
            first = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
            group = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            keep = np.arange(len(ids)) - start[group] <= TOP
            asks = np.bincount(group, ids % every == 0) > 0
            cut = np.concatenate([[0], np.cumsum(np.bincount(group[keep]))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[start].tolist(), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids[keep])), pa.array(asks)], names=["v", "ids", "asks"]
            )

    parts = df.mapInArrow(in_task, "v array<double>, ids array<bigint>, asks boolean")
    salted = parts.groupBy("v", F.pmod(F.col("ids")[0], F.lit(61)).alias("salt")).agg(*merged())
    return salted.groupBy("v").agg(*merged()).select(F.col("ids")[0].alias("key"), "v", "ids", "asks")


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    d = (c**2).sum(1)[None] - 2 * x @ c.T
    if k == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def probes_for(sample: np.ndarray, centres: np.ndarray, target: float, queries: int = 256) -> int:
    """The fewest probes with which sampled queries find the target share of their true neighbours in the sample."""
    asked = sample[:queries]
    d = (sample**2).sum(1)[None] - 2 * asked @ sample.T
    true = np.argsort(d, axis=1, kind="stable")[:, 1 : TOP + 1]
    place = np.argsort(nearest(asked, centres, len(centres)), axis=1)
    at = nearest(sample, centres, 1)[:, 0]
    ranks = np.sort(np.take_along_axis(place, at[true], axis=1), axis=None)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else 1


def rotation(n: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]


def scan(queries: np.ndarray, x: np.ndarray, turn: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, distance): for each query the `keep` nearest rows found, nearest first, ties to the earlier row.

    The first rows give each query its limit; all others start with the first
    column block, for all pairs at once, and only pairs that pass the test go on.
    """
    d = x.shape[1]
    rotated, asked = (x @ turn).astype(np.float32), (queries @ turn).astype(np.float32)
    first = min(len(x), max(4 * keep, 128))
    squares = lambda a, b: np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)
    q, at = (i.ravel() for i in np.indices((len(queries), first)))
    if len(x) > first:
        limit = np.partition(squares(asked, rotated[:first]), keep - 1, axis=1)[:, keep - 1] * 1.001 + 1e-6
        part = squares(asked[:, :COLUMNS], rotated[first:, :COLUMNS])
        seen = min(COLUMNS, d)
        qi, xi = np.nonzero(part * (d / seen) <= limit[:, None] * ((1 + SURE / np.sqrt(seen)) ** 2 if seen < d else 1))
        part, xi = part[qi, xi], xi + first
        for lo in range(COLUMNS, d, COLUMNS):
            seen = min(lo + COLUMNS, d)
            part = part + ((rotated[xi, lo:seen] - asked[qi, lo:seen]) ** 2).sum(1)
            alive = part * (d / seen) <= limit[qi] * ((1 + SURE / np.sqrt(seen)) ** 2 if seen < d else 1)
            qi, xi, part = qi[alive], xi[alive], part[alive]
        q, at = np.concatenate([q, qi]), np.concatenate([at, xi])
    dist = np.concatenate([np.sqrt(((x[at[i : i + 65536]] - queries[q[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    order = np.lexsort((at, dist, q))
    q, at, dist = q[order], at[order], dist[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < keep
    return q[near], at[near], dist[near]


def _search(asks: DataFrame, index: DataFrame, sizes: dict[int, int], probes: int, centres: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(key, found): for each query vector its nearest (dist, id), TOP + 1 at most."""
    blocks = {k: -(-n // BLOCK_ROWS) for k, n in sizes.items()}

    def probe(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist())
            lists = nearest(x, centres, probes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists.tolist(), pa.list_(pa.int32()))], names=["key", "v", "lists"])

    cut = F.create_map(*[F.lit(x) for kv in sorted(blocks.items()) for x in kv])
    probed = stored(asks.select("key", "v").mapInArrow(probe, "key long, v array<double>, lists array<int>"))
    probed = probed.select("key", "v", F.explode("lists").alias("list")).filter(F.col("list").isin(*sizes))
    asked = {r["list"]: -(-r["n"] // BLOCK_QUERIES) for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    if not asked:
        return asks.sparkSession.createDataFrame([], "key long, found array<struct<dist double, id long>>")
    groups = F.create_map(*[F.lit(x) for kv in sorted(asked.items()) for x in kv])
    left = probed.select("list", F.explode(F.sequence(F.lit(0), cut[F.col("list")] - 1)).alias("block"), F.pmod(F.xxhash64("key"), groups[F.col("list")]).cast("int").alias("part"), "key", "v")
    right = index.filter(F.col("list").isin(*asked)).select(
        "list", F.pmod(F.xxhash64("key"), cut[F.col("list")]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), groups[F.col("list")] - 1)).alias("part"), "ids", "v"
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keys, dists, ids = [], [], []
        if len(a) and len(b):
            b = b.assign(first=b["ids"].str[0]).sort_values("first")
            x, own = np.stack(b["v"].to_numpy()), b["ids"].to_list()
            key = a["key"].to_numpy()
            for q, j, d in zip(*(z.tolist() for z in scan(np.stack(a["v"].to_numpy()), x, turn, TOP + 1)), strict=True):
                keys += [key[q]] * len(own[j])
                dists += [d] * len(own[j])
                ids += list(own[j])
        return pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "dist": pd.Series(dists, dtype="float64"), "id": pd.Series(ids, dtype="int64")})

    on = ["list", "block", "part"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, "key long, dist double, id long")
    nearest_of = lambda x: F.slice(F.array_sort(x), 1, TOP + 1)
    salted = found.groupBy("key", F.pmod("id", F.lit(31)).alias("salt")).agg(nearest_of(F.collect_list(F.struct("dist", "id"))).alias("found"))
    return salted.groupBy("key").agg(nearest_of(F.flatten(F.collect_list("found"))).alias("found"))


def neighbours(vectors: DataFrame, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", target: float = 0.97) -> DataFrame:
    """The TOP nearest of every row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = valid(vectors, vec_id, embedding)
    unique = stored(distinct_vectors(rows, every))
    n = unique.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r["v"] for r in unique.orderBy(F.xxhash64("key"), "key").select("v").limit(SAMPLE_ROWS).collect()])
    lists = min(LISTS, max(1, int(np.sqrt(n))), len(sample))
    centres, turn = k_means(sample, lists), rotation(sample.shape[1])

    def assign(batches):
        for b in batches:
            at = nearest(np.array(b.column(1).to_pylist()), centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=["key", "v", "ids", "asks", "list"])

    index = stored(unique.mapInArrow(assign, "key long, v array<double>, ids array<bigint>, asks boolean, list int"))
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    asks = index.filter("asks")
    probes = min(lists, max(8, probes_for(sample, centres, target)))
    found = stored(_search(asks, index, sizes, probes, centres, turn))
    if probes < lists:
        few = stored(asks.join(found.filter(F.size("found") > TOP).select("key"), "key", "left_anti"))
        if few.limit(1).count():
            found = found.join(few.select("key"), "key", "left_anti").unionByName(_search(few, index, sizes, lists, centres, turn))
    queries = rows.filter(F.col("id") % every == 0).join(index.filter("asks").select("v", "key"), "v").select("id", "key")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, TOP)
    return queries.join(found, "key").select("id", F.posexplode(others).alias("rank", "x")).select(F.col("id").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.dist").alias("score"))

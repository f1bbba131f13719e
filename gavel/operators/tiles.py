"""Products, attention and top-k over tables whose vectors are rows, in blocks: no side is broadcast and no task holds more than its block.

A row goes to each block that needs it and to no other, so each side of a product is shuffled once; a block's arithmetic is one
numpy product. What blocks give is small (a best value, a partial softmax, k candidates) and merges in any grouping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gavel.functions.integer import Strategy, matmul, quantize, unpack
from gavel.functions.quant import decode, encode

#: Rows of a block of each side.
BLOCK = 512
#: Bytes of a block of which only the best is kept; blocks of a side at least, where there are rows enough; tasks that tiles are dealt to.
BLOCK_BYTES, LEAST_BLOCKS, MOST_TASKS = 32 << 20, 8, 2_000
#: Rows and columns of a product that are multiplied at once.
AT_ONCE = 512
#: Columns up to which integer products are measured by sums of their rows' outer products.
GRAM = 256
#: Groups whose candidates a task holds before it hands them on.
HELD_GROUPS = 50_000
#: Rows that are compared at once.
SLICE = 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)]).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _block(rows: DataFrame, count: int, block: int):
    """A row's block: by hash, so that ids may lie anywhere."""
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // block)))).cast("int")


def _tiles(a: DataFrame, b: DataFrame, block: int, *more: str) -> DataFrame:
    """(i, j, side, id, x, more): rows of a (id, x) in every tile of their row of tiles, rows of b in every tile of their column."""
    na, nb = a.count(), b.count()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // block)) - 1)))
    left = a.select("id", "x", *more, _block(a, na, block).alias("i")).select("i", every(nb).alias("j"), F.lit(0).alias("side"), "id", "x", *more)
    right = b.select("id", "x", *more, _block(b, nb, block).alias("j")).select(every(na).alias("i"), "j", F.lit(1).alias("side"), "id", "x", *more)
    return left.union(right)


def _sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    side, ids = tile.column("side").to_numpy(), tile.column("id").to_numpy()
    x = _matrix(tile.column("x"))
    out = []
    for s in (0, 1):
        at = np.flatnonzero(side == s)
        at = at[np.argsort(ids[at], kind="stable")]
        out += [ids[at], x[at]]
    return tuple(out)


def product(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, col, y): all products of rows of a (id, x) with rows of b (id, x)."""

    def multiply(tile: pa.Table) -> pa.Table:
        rows, x, cols, w = _sides(tile)
        y = x @ w.T if len(rows) and len(cols) else np.zeros((len(rows), len(cols)))
        return pa.table({"row": np.repeat(rows, len(cols)), "col": np.tile(cols, len(rows)), "y": y.ravel()})

    return _tiles(a, b, block).groupBy("i", "j").applyInArrow(multiply, "row long, col long, y double")


def largest_product(a: DataFrame, b: DataFrame, own: bool = False, block: int | None = None) -> DataFrame:
    """(row, col, y): for each row of a (id, x) the row of b with the largest product, the smaller id of equals; own: a row may be its own best. Rows of a without another row in b are left out.

    A block is as large as BLOCK_BYTES allows, as every row goes to as many tiles as the other side has blocks; a tile's product is made AT_ONCE rows and columns at a time.
    """
    if block is None:
        n = max(a.count(), b.count())
        block = max(1, min(BLOCK_BYTES // (8 * max(1, _columns(a))), max(BLOCK, -(-n // LEAST_BLOCKS))))

    def best(tile: pa.Table) -> pa.Table:
        rows, x, cols, w = _sides(tile)
        if not len(rows) or not len(cols):
            return pa.table({"row": pa.array([], pa.int64()), "col": pa.array([], pa.int64()), "y": pa.array([], pa.float64())})
        top, at = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        meet = not own and np.isin(rows, cols).any()
        numbers = math.isfinite(np.abs(x).max(initial=0) * np.abs(w).max(initial=0) * x.shape[1])  # then no product is NaN
        for r in range(0, len(rows), AT_ONCE):
            for c in range(0, len(cols), AT_ONCE):
                y = x[r : r + AT_ONCE] @ w[c : c + AT_ONCE].T
                if meet:
                    y[rows[r : r + AT_ONCE, None] == cols[c : c + AT_ONCE]] = -np.inf
                if not numbers:
                    np.copyto(y, -np.inf, where=np.isnan(y))
                value = y.max(1)
                more = np.flatnonzero(value > top[r : r + AT_ONCE])
                top[r + more], at[r + more] = value[more], c + y[more].argmax(1)
        keep = top > -np.inf
        return pa.table({"row": rows[keep], "col": cols[at][keep], "y": top[keep]})

    tiles = max(1, -(-a.count() // block)) * max(1, -(-b.count() // block))
    each = _tiles(a, b, block).repartition(min(tiles, MOST_TASKS), "i", "j").groupBy("i", "j").applyInArrow(best, "row long, col long, y double")
    return each.groupBy("row").agg(F.max(F.struct("y", (-F.col("col")).alias("c"))).alias("m")).select("row", (-F.col("m.c")).alias("col"), F.col("m.y").alias("y"))


def _columns(rows: DataFrame) -> int:
    """Entries of a vector; 0 without one."""
    first = rows.filter("x is not null").select(F.size("x")).first()
    return first[0] if first else 0


def packed_rows(rows: DataFrame, kind: str) -> DataFrame:
    """(id, packed) of rows (id, x), quantized; x must be whole blocks."""

    @pandas_udf("binary")
    def pack(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: encode(kind, np.asarray(x)), na_action="ignore")

    return rows.select("id", pack("x").alias("packed"))


def integer_error(tokens: DataFrame, weights: DataFrame, kind: str, block: int = BLOCK) -> DataFrame:
    """(row, relative_l2): how far the integer product of each token (id, x) with all packed rows (id, packed) is from the float product with their decoded values.

    Both products are linear in the packed row: with w the decoded row and v = scale * codes + offset, x the token and q its codes * scales, the integer product is q v and
    the float one x w, and their difference (q - x) v + x (v - w). So the sum of squares over all rows is a quadratic form of the token, by the summed outer products
    of (v, v - w): each side is read once. Beyond GRAM columns both products are made tile by tile; the squares of difference and product are what a tile gives.
    Either is added up by token.
    """
    n = _columns(tokens)
    if 0 < n <= GRAM:
        parts = _squares_by_form(tokens, weights, kind, n)
    else:
        parts = _squares_by_tiles(tokens, weights, kind, block)
    norm, base = F.sqrt(F.sum("d")), F.sqrt(F.sum("y"))
    return parts.groupBy("row").agg(F.when(base == 0, norm).otherwise(norm / base).alias("relative_l2"))


def _squares_by_form(tokens: DataFrame, weights: DataFrame, kind: str, n: int) -> DataFrame:
    """(row, d, y): squares of differences and of float products, summed over all packed rows."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = None
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                raw = b"".join(batch.column(0).slice(s, SLICE).to_pylist())
                codes, scale, offset = unpack(kind, raw)
                v = (codes * scale[:, None].astype(np.float64) + offset[:, None].astype(np.float64)).reshape(-1, n)
                z = np.concatenate([v, v - decode(kind, raw).reshape(-1, n)], 1)
                form = z.T @ z if form is None else form + z.T @ z
        if form is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), pa.array(list(form), pa.list_(pa.float64()))], names=["i", "form"])

    def added(part: pa.Table) -> pa.Table:
        return pa.table({"i": part.column("i")[:1], "form": pa.array([_matrix(part.column("form")).sum(0)], pa.list_(pa.float64()))})

    summed = weights.select("packed").mapInArrow(outer, "i long, form array<double>").groupBy("i").applyInArrow(added, "i long, form array<double>")
    found = summed.toArrow().sort_by("i")
    shared = tokens.sparkSession.sparkContext.broadcast(_matrix(found.column("form")) if found.num_rows else None)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows if form is not None else 0, SLICE):
                part = batch.slice(s, SLICE)
                x = _matrix(pa.chunked_array([part.column(1)])).astype(np.float32)
                codes, scale = quantize(x)
                q = (codes * scale[:, :, None].astype(np.float64)).reshape(x.shape)
                x = x.astype(np.float64)
                far, near = np.concatenate([q - x, x], 1), np.concatenate([x, -x], 1)
                sums = [np.maximum(((u @ form) * u).sum(1), 0) for u in (far, near)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["row", "d", "y"])

    return tokens.select("id", "x").mapInArrow(squares, "row long, d double, y double")


def _squares_by_tiles(tokens: DataFrame, weights: DataFrame, kind: str, block: int) -> DataFrame:
    """The same, tile by tile."""

    def squares(tile: pa.Table) -> pa.Table:
        side, ids = tile.column("side").to_numpy(), tile.column("id").to_numpy()
        asks, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        raw = b"".join(tile.column("packed").take(pa.array(cols)).to_pylist())
        x = _matrix(tile.column("x").take(pa.array(asks)))
        if not len(asks) or not len(cols):
            return pa.table({"row": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "y": pa.array([], pa.float64())})
        y = matmul(kind, raw, len(cols), x, Strategy.FLOAT, sums=np.float64)
        d = matmul(kind, raw, len(cols), x, Strategy.INTEGER, sums=np.float64) - y
        return pa.table({"row": ids[asks], "d": (d * d).sum(1), "y": (y * y).sum(1)})

    left = tokens.select("id", "x", F.lit(None).cast("binary").alias("packed"))
    right = weights.select("id", F.lit(None).cast(dict(tokens.dtypes)["x"]).alias("x"), "packed")
    return _tiles(left, right, block, "packed").groupBy("i", "j").applyInArrow(squares, "row long, d double, y double")


def _attended(scale: float):
    def partial(tile: pa.Table) -> pa.Table:
        """A block of queries with a block of keys: of each query the greatest score, the sum of exponentials below it, and the values they weigh."""
        side, pos = tile.column("side").to_numpy(), tile.column("pos").to_numpy()
        asks, keys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        keys = keys[np.argsort(pos[keys], kind="stable")]
        q = _matrix(tile.column("a").take(pa.array(asks)))
        k, v = (_matrix(tile.column(c).take(pa.array(keys))) for c in ("a", "v"))
        s = np.where(pos[keys] <= pos[asks][:, None], q @ k.T * scale, -np.inf)
        m = s.max(1, initial=-np.inf)
        w = np.exp(s - np.where(np.isfinite(m), m, 0)[:, None])
        keep = np.flatnonzero(np.isfinite(m))
        total = (w @ v)[keep]
        out = {"seq": tile.column("seq").to_numpy()[asks][keep], "pos": pos[asks][keep], "kb": tile.column("kb").to_numpy()[asks][keep], "m": m[keep], "l": w.sum(1)[keep]}
        return pa.table(out | {"o": pa.array(list(total), pa.list_(pa.float64()))})

    return partial


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial softmaxes of one query after another to its result; only that of the current query is held."""
    now, state, out = None, None, []
    schema = pa.schema([("seq", pa.int64()), ("pos", pa.int64()), ("o", pa.list_(pa.float64()))])

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for seq, pos, _, m, l, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
            o = np.array(o)
            if (seq, pos) != now:
                if now:
                    out.append((*now, state[2] / state[1]))
                now, state = (seq, pos), (m, l, o)
            else:
                top = max(m, state[0])
                a, b = math.exp(state[0] - top), math.exp(m - top)
                state = (top, state[1] * a + l * b, state[2] * a + o * b)
        if len(out) >= 1000:
            yield rows()
            out.clear()
    if now:
        out.append((*now, state[2] / state[1]))
    if out:
        yield rows()


def causal_attention(rows: DataFrame, scale: float | None = None, block: int = BLOCK, dim: int | None = None) -> DataFrame:
    """(seq, pos, o) for rows (seq, pos, q, k, v) of sequences of any length: a position attends to itself and those before it.

    Queries meet keys in tiles of block x block positions; a tile gives mergeable partial softmaxes, merged in the keys' order. scale: 1 / sqrt(dim) if dim is given.
    """
    scale = scale if scale is not None else 1 / math.sqrt(dim)
    rows = rows.select(F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "q", "k", "v").withColumn("b", F.floor(F.col("pos") / block).cast("long"))
    last = rows.groupBy("seq").agg(F.max("b").alias("last"))
    none = F.array().cast("array<double>")
    asks = rows.select("seq", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("kb"), F.lit(0).alias("side"), "pos", F.col("q").alias("a"), none.alias("v"))
    keys = rows.join(last, "seq").select("seq", F.explode(F.sequence("b", "last")).alias("qb"), F.col("b").alias("kb"), F.lit(1).alias("side"), "pos", F.col("k").alias("a"), "v")
    parts = asks.union(keys).groupBy("seq", "qb", "kb").applyInArrow(_attended(scale), "seq long, pos long, kb long, m double, l double, o array<double>")
    in_order = parts.repartition("seq", "pos").sortWithinPartitions("seq", "pos", "kb")
    return in_order.mapInArrow(_merged, "seq long, pos long, o array<double>")


def _kept(k: int):
    """Of each group the k first by value (greatest first, NaN last) and token: a task holds k candidates a group, and hands them on when it has many groups."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def merge(group, value: np.ndarray, token: np.ndarray) -> None:
            if group in held:
                value, token = np.concatenate([held[group][0], value]), np.concatenate([held[group][1], token])
            order = np.lexsort((token, -value, np.isnan(value)))[:k]
            held[group] = (value[order], token[order])

        def rows() -> Iterator[pa.RecordBatch]:
            groups = list(held)
            for i in range(0, len(groups), 2000):
                part = groups[i : i + 2000]
                names = pa.array([g for g in part for _ in held[g][0]], kind)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([held[g][1] for g in part])), pa.array(np.concatenate([held[g][0] for g in part]))], names=["group", "token", "value"])

        kind = pa.string()
        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                codes = part.column(0).dictionary_encode()
                value, token = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64), part.column(1).to_numpy(zero_copy_only=False)
                index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(index, kind="stable")
                cuts = np.flatnonzero(np.diff(index[order])) + 1
                for own in np.split(order, cuts):
                    if len(own):
                        merge(None if index[own[0]] < 0 else codes.dictionary[int(index[own[0]])].as_py(), value[own], token[own])
            if len(held) > HELD_GROUPS:
                yield from rows()
                held = {}
        yield from rows()

    return keep


def top_k(rows: DataFrame, group: str, token: str, value: str, k: int) -> DataFrame:
    """(group, rank, token, value): each group's k greatest values, ties by token, NaN last; null values take no part.

    Every task keeps k candidates a group; these alone are shuffled, first by (group, task's part) and then by group, so a group with most of the rows is
    no large one. No sort but that of candidates.
    """
    given = dict(rows.dtypes)[group]
    schema = f"group {given}, token long, value double"
    own = rows.select(F.col(group).alias("group"), F.col(token).cast("long").alias("token"), F.col(value).cast("double").alias("value")).filter("value is not null")
    first = own.mapInArrow(_kept(k), schema)
    spread = first.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("group", "part").drop("part").mapInArrow(_kept(k), schema)
    last = spread.repartition("group").mapInArrow(_kept(k), schema)
    by_group = F.array_sort(F.collect_list(F.struct(F.isnan("value").alias("n"), (-F.col("value")).alias("v"), "token", "value")))
    listed = last.groupBy("group").agg(by_group.alias("p")).select("group", F.posexplode("p").alias("rank", "p"))
    return listed.select(F.col("group").alias(group), F.col("rank").alias("rank"), F.col("p.token").alias(token), F.col("p.value").alias(value))

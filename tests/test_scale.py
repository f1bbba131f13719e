"""Blocked products, mergeable attention and top-k, shared prefixes and the GGUF sink against plain computations."""

import json
import math
import os
import random

import numpy as np
import pytest

from gavel.functions.integer import Strategy, matmul
from gavel.functions.quant import decode, encode
from gavel.operators import prefixes, tables, tiles
from gavel.sources import register
from gavel.sources.gguf import GgufFile, write_tensors

VECTORS = "id long, x array<double>"


def _vectors(spark, n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x, spark.createDataFrame([(i * 7 - 20, r.tolist()) for i, r in enumerate(x)], VECTORS)


def test_products_in_blocks(spark):
    a, da = _vectors(spark, 37, 9, 1)
    b, db = _vectors(spark, 23, 9, 2)
    got = {(r.row, r.col): r.y for r in tiles.product(da, db, block=8).collect()}
    assert len(got) == 37 * 23
    for i in range(37):
        for j in range(23):
            assert math.isclose(got[i * 7 - 20, j * 7 - 20], a[i] @ b[j], abs_tol=1e-12)
    assert tiles.product(da, db.limit(0), block=8).count() == 0


def test_largest_product_is_that_of_all(spark):
    a, da = _vectors(spark, 60, 5, 3)
    a[10] = a[11] = a[12]  # equal rows: the smaller id
    a[20, 0] = np.nan
    da = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], VECTORS)
    y = a @ a.T
    np.fill_diagonal(y, -np.inf)
    y[np.isnan(y)] = -np.inf
    got = {r.row: (r.col, r.y) for r in tiles.largest_product(da, da, block=16).collect()}
    assert set(got) == set(range(60)) - {20}
    for i, (col, v) in got.items():
        assert math.isclose(v, y[i].max(), abs_tol=1e-12) and math.isclose(y[i, col], v, abs_tol=1e-12)
    assert tiles.largest_product(da.limit(1), da.limit(1)).count() == 0 and tiles.largest_product(da.limit(1), da.limit(1), own=True).count() == 1


@pytest.mark.parametrize("kind", ["Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1"])
def test_integer_products_are_near_the_float_ones(spark, kind):
    x, rows = _vectors(spark, 40, 64, 6)
    got = {r.row: r.relative_l2 for r in tiles.integer_error(rows, tiles.packed_rows(rows, kind), kind, block=8).collect()}
    w, far = decode(kind, encode(kind, x)).reshape(40, 64).astype(float), matmul(kind, encode(kind, x), 40, x, Strategy.INTEGER)
    want = np.sqrt(((far - x.astype(np.float32) @ w.T) ** 2).sum(1) / ((x.astype(np.float32) @ w.T) ** 2).sum(1))
    assert len(got) == 40 and all(math.isclose(got[i * 7 - 20], want[i], rel_tol=1e-3) and got[i * 7 - 20] < 0.01 for i in range(40))
    with pytest.raises(Exception, match="no integer product"):
        tiles.integer_error(rows, tiles.packed_rows(rows, "MXFP4"), "MXFP4").collect()


@pytest.mark.parametrize("kind", ["Q8_0", "Q5_1"])
def test_integer_errors_by_one_form_equal_those_of_all_pairs(spark, monkeypatch, kind):
    """The rows of both sides are read once, and nothing is joined; the sums are those of the tiles."""
    x, rows = _vectors(spark, 90, 64, 8)
    weights = tiles.packed_rows(rows, kind)
    form = tiles.integer_error(rows, weights, kind)
    plan = form._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Union" not in plan
    monkeypatch.setattr(tiles, "GRAM", 0)
    want = {r.row: r.relative_l2 for r in tiles.integer_error(rows, weights, kind, block=16).collect()}
    got = {r.row: r.relative_l2 for r in form.collect()}
    assert set(got) == set(want) and len(got) == 90 and all(math.isclose(got[k], want[k], rel_tol=1e-11) for k in want)
    monkeypatch.setattr(tiles, "GRAM", 256)
    assert tiles.integer_error(rows, weights.limit(0), kind).count() == 0 and tiles.integer_error(rows.limit(0), weights, kind).count() == 0


def test_blocks_of_the_largest_product_grow_with_the_table(spark, monkeypatch):
    """Every row goes to a bounded number of tiles, as long as a block's bytes allow it."""
    x, rows = _vectors(spark, 300, 4, 9)
    monkeypatch.setattr(tiles, "BLOCK", 4)
    monkeypatch.setattr(tiles, "AT_ONCE", 7)
    sent, made = [], tiles._tiles
    monkeypatch.setattr(tiles, "_tiles", lambda *a: sent.append(made(*a)) or sent[-1])
    got = {r.row: (r.col, r.y) for r in tiles.largest_product(rows, rows).collect()}
    y = x @ x.T
    np.fill_diagonal(y, -np.inf)
    assert sent[0].count() == 2 * 300 * tiles.LEAST_BLOCKS
    assert all(got[i * 7 - 20][0] == y[i].argmax() * 7 - 20 and math.isclose(got[i * 7 - 20][1], y[i].max(), abs_tol=1e-12) for i in range(300))


def test_tiles_are_shuffled_once_a_side_and_not_broadcast(spark):
    _, da = _vectors(spark, 20, 4, 5)
    plan = tiles.largest_product(da, da, block=8)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block", [1, 5, 64])
def test_attention_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(block)
    lengths, rows, want = [1, 4, 5, 23], [], {}
    for s, n in enumerate(lengths):
        q, k, v = rng.standard_normal((n, 6)) * 30, rng.standard_normal((n, 6)) * 30, rng.standard_normal((n, 3))
        for p in range(n):
            rows.append((s, p, q[p].tolist(), k[p].tolist(), v[p].tolist()))
            w = q[p] @ k[: p + 1].T / math.sqrt(6)
            w = np.exp(w - w.max())
            want[s, p] = w @ v[: p + 1] / w.sum()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, pos long, q array<double>, k array<double>, v array<double>")
    got = {(r.seq, r.pos): r.o for r in tiles.causal_attention(df, dim=6, block=block).collect()}
    assert set(got) == set(want)
    for key, o in got.items():
        assert np.allclose(o, want[key], atol=1e-12)


@pytest.mark.parametrize("held", [2, 50_000])
def test_top_k_keeps_the_first(spark, monkeypatch, held):
    monkeypatch.setattr(tiles, "HELD_GROUPS", held)
    rng = random.Random(held)
    value = lambda: rng.choice([1.0, 2.0, 3.5, float("nan"), float("-inf"), float("inf"), rng.random(), None])
    rows = [(rng.choice(["a"] * 9 + ["b", "c", None, "d"]), t, value()) for t in range(900)] + [("few", 1, float("nan")), ("few", 0, 1.0)]
    want = {}
    for g, t, v in rows:
        if v is not None:
            want.setdefault(g, []).append((math.isnan(v), 0 if math.isnan(v) else -v, t))
    df = spark.createDataFrame(rows, "g string, t long, v double").repartition(7)
    top = tiles.top_k(df, "g", "t", "v", 20)
    got = {}
    for r in top.orderBy("rank").collect():
        got.setdefault(r.g, []).append(r.t)
    assert got == {g: [t for *_, t in sorted(x)[:20]] for g, x in want.items()}
    assert "rangepartitioning" not in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [1, 200_000])
def test_longest_prefix(spark, monkeypatch, bound):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", bound)
    rng = random.Random(bound)
    seqs = [[rng.choice([1, 2]) for _ in range(rng.choice([0, 1, 3, 16, 17, 40, 300]))] for _ in range(25)]
    asking = [[*rng.choice(seqs)[: rng.randint(0, 300)], *[rng.choice([1, 2, 3]) for _ in range(rng.randint(0, 20))]] for _ in range(60)] + [None, []]

    def shared(x):
        return None if x is None else max((next((i for i, (a, b) in enumerate(zip(x, s, strict=False)) if a != b), min(len(x), len(s))) for s in seqs), default=0)

    index = spark.createDataFrame([(s,) for s in [*seqs, None]], "s array<int>")
    got = {r.k: r.shared for r in prefixes.longest_shared_prefix(spark.createDataFrame(list(enumerate(asking)), "k int, t array<int>"), "k", "t", index, "s").collect()}
    assert got == {i: shared(x) for i, x in enumerate(asking)}
    text = lambda x: None if x is None else "".join("_ab𝒜"[c] for c in x)
    words = spark.createDataFrame([(text(s),) for s in seqs], "s string")
    got = {r.k: r.shared for r in prefixes.longest_shared_prefix(spark.createDataFrame([(i, text(x)) for i, x in enumerate(asking)], "k int, t string"), "k", "t", words, "s").collect()}
    assert got == {i: shared(x) for i, x in enumerate(asking)}
    empty = prefixes.longest_shared_prefix(spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string"), "k", "t", words.limit(0), "s")
    assert {r.k: r.shared for r in empty.collect()} == {1: 0, 2: None}


ROWS = "tensor string, row_id long, values array<float>"


@pytest.mark.parametrize("kind", ["F32", "F16", "BF16", "Q8_0", "Q5_1", "Q5_0", "Q4_1", "Q4_0", "MXFP4"])
def test_sink_writes_what_the_encoder_gives(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    w = {"blk.0.attn_q.weight": rng.standard_normal((300, 64)), "blk.0.ffn_up.weight": rng.standard_normal((7, 40)), "output_norm.weight": rng.standard_normal((1, 64))}
    rows = [(n, i, r.tolist()) for n, x in w.items() for i, r in enumerate(x)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "m.gguf")
    write_tensors(spark.createDataFrame(rows, ROWS).repartition(5), path, kind, {"general.name": ("string", "made"), "a.b": ("array[int32]", [1, 2])})
    file = GgufFile(path)
    assert os.listdir(tmp_path) == ["m.gguf"] and file.get("general.name") == "made" and file.get("a.b") == [1, 2]
    assert [(t.name, t.shape) for t in file.tensors] == [("blk.0.attn_q.weight", (64, 300)), ("blk.0.ffn_up.weight", (40, 7)), ("output_norm.weight", (64,))]
    quantized = kind not in ("F32", "F16", "BF16")
    kinds = [kind, "F16" if quantized else kind, "F32" if quantized else kind]
    assert [t.kind.name for t in file.tensors] == kinds
    for t, own in zip(file.tensors, kinds, strict=True):
        assert np.array_equal(file.values(t.name).ravel(), decode(own, encode(own, w[t.name])))
    register(spark)
    again = spark.read.format("gguf").option("path", path).option("view", "rows").load().filter("tensor = 'blk.0.attn_q.weight'").orderBy("row_id").collect()
    assert b"".join(bytes(r.packed) for r in again) == encode(kind, w["blk.0.attn_q.weight"])


def test_sink_refuses_and_leaves_nothing(spark, tmp_path):
    register(spark)
    good = [("w", i, [1.0] * 32) for i in range(4)]
    for rows, said in (([*good, ("w", 5, [1.0] * 32)], "missing"), ([*good, ("w", 2, [1.0] * 32)], "twice"), ([*good, ("w", 4, [1.0] * 64)], "values"), ([*good, ("w", 4, [1.0, None])], "null"), ([*good, (None, 4, [1.0])], "null")):
        with pytest.raises(Exception, match=said):
            write_tensors(spark.createDataFrame(rows, ROWS), str(tmp_path / "m.gguf"))
        assert os.listdir(tmp_path) == []
    df = spark.createDataFrame(good, ROWS)
    df.select("row_id", "values").write.format("gguf").mode("append").option("tensor", "named").option("type", "q4_0").save(str(tmp_path / "m.gguf"))
    assert [(t.name, t.rows, t.kind.name) for t in GgufFile(str(tmp_path / "m.gguf")).tensors] == [("named", 4, "Q4_0")]
    with pytest.raises(Exception, match="exists"):
        df.write.format("gguf").mode("append").save(str(tmp_path / "m.gguf"))
    with pytest.raises(Exception, match="not known"):
        df.write.format("gguf").mode("overwrite").option("type", "Q9").save(str(tmp_path / "m.gguf"))
    write_tensors(df, "file://" + str(tmp_path / "m.gguf"), "F32")
    assert GgufFile(str(tmp_path / "m.gguf")).tensors[0].kind.name == "F32"
    write_tensors(df.limit(0), str(tmp_path / "none.gguf"))
    assert GgufFile(str(tmp_path / "none.gguf")).tensors == []


def test_documents_from_files(spark, tmp_path, tiny_model, capsys):
    from gavel import cli
    from gavel.sources.documents import read_documents

    (tmp_path / "in").mkdir()
    texts = {"a.txt": b"one\ntwo\r\n\n", "b.txt": "é🚨".encode(), "c.txt": b"bad \xff end", "in/d.txt": b"", "e.md": b"other"}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.doc_id.split(f"{tmp_path}/")[1]: r.text for r in read_documents(spark, str(tmp_path), "*.txt").collect()}
    assert got.pop("in/d.txt", "") == ""  # an empty file has an empty text or no row
    assert got == {k: v.decode("utf-8", "replace") for k, v in texts.items() if k.endswith(".txt") and v}
    capsys.readouterr()
    assert cli.main(["moderate", tiny_model, "--documents", str(tmp_path / "a.txt")]) == 0
    line = json.loads(capsys.readouterr().out.strip())
    assert line["doc_id"].endswith("a.txt") and 0 <= line["score"] <= 1

"""Column functions and decoders against plain definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.functions import bpe, quant, tensors, text
from gavel.functions.geometry import BY_NAME, parse


def test_every_type_has_a_decoder_of_its_geometry():
    rng = np.random.default_rng(0)
    assert set(quant.DECODERS) == set(BY_NAME)
    for t in BY_NAME.values():
        raw = rng.integers(0, 256, 8 * t.size, dtype=np.uint8)
        with np.errstate(all="ignore"):
            one = [quant.decode(t.name, raw[i * t.size : (i + 1) * t.size].tobytes()) for i in range(8)]
            all_ = quant.decode(t.name, raw.tobytes())
        assert all_.size == 8 * t.elements
        np.testing.assert_array_equal(np.concatenate(one), all_)
        with pytest.raises(ValueError):
            quant.decode(t.name, raw.tobytes() + b"x") if t.size > 1 else quant.decode("Q8_0", b"x")


def test_all_halves():
    raw = np.arange(1 << 16, dtype="<u2")
    np.testing.assert_array_equal(quant.decode("F16", raw.tobytes()), raw.view(np.float16).astype(np.float32))


def test_q8_round_trip():
    x = np.random.default_rng(1).standard_normal(320).astype(np.float32)
    y = quant.decode("Q8_0", quant.encode("Q8_0", x))
    size = np.abs(x.reshape(-1, 32)).max(1).repeat(32)
    assert (np.abs(x - y) <= size / 254 * 1.05).all()
    assert not quant.decode("Q8_0", quant.encode("Q8_0", np.zeros(32))).any()
    rough = quant.decode("Q4_0", quant.encode("Q4_0", x))
    assert np.abs(x - rough).max() < np.abs(x).max() / 7
    np.testing.assert_allclose(quant.decode("BF16", quant.encode("BF16", x)), x, rtol=1 / 128)


def test_geometry():
    assert parse("q4_k").size == 144 and parse("nope") is None
    with pytest.raises(ValueError):
        BY_NAME["Q8_0"].row_bytes(33)


def test_pre_tokens_equal_code_point_regex(spark):
    import regex

    rng = random.Random(4)
    parts = [" ", "  ", "\t", "\n", "\r\n", "\xa0", "\x85", "a", "B", "é", "É", "ß", "日", "🚨", "1", "2", "'", "/", ".", "é", "—", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.pre_tokens("t").alias("p")).collect()
    for r in rows:
        assert r["p"] == regex.findall(text.PRE_TOKEN, texts[r["i"]])
        assert "".join(r["p"]) == texts[r["i"]]


def _merge_slowly(v, piece):
    if piece in v.ids:
        return [v.ids[piece]]
    s = list(piece)
    while True:
        best = min(((v.ranks[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in v.ranks and p[0] + p[1] in v.ids), default=None)
        if best is None:
            return [v.ids[x] for x in s if x in v.ids]
        i = best[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


def test_merges_equal_plain_loop():
    v = bpe.tiny_vocabulary(("the", "then", "hen", "ann", "banana", "nana", " the", "in", "ing", "ining"))
    rng = random.Random(3)
    for _ in range(2000):
        p = bpe.to_alphabet("".join(rng.choice(["a", "n", "b", "t", "h", "e", "i", "g", " ", "é"]) for _ in range(rng.randint(1, 14))))
        assert v.merge(p) == _merge_slowly(v, p)


def test_derived_merges_rebuild_the_vocabulary():
    v = bpe.tiny_vocabulary()
    merges = bpe.derive_merges(list(v.pieces[8:]))
    assert [a + b for a, b in merges] == [p for p in v.pieces[8:] if len(p) > 1]
    assert bpe.derive_merges(["a", "b", "ab", "abab", "xyz"]) == [("a", "b"), ("ab", "ab")]


def test_softmax_edges(spark):
    rows = [(0, [1.0, 2.0, 400.0]), (1, [float("-inf")] * 3), (2, []), (3, [float("inf"), 0.0]), (4, [float("nan"), 1.0])]
    out = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", tensors.softmax("x").alias("s")).collect()}
    assert out[0][2] == pytest.approx(1) and out[1] == pytest.approx([1 / 3] * 3) and out[2] == [] and out[3] == [0.5, 0.5] and out[4] == [0.5, 0.5]


def test_best_ignores_nan(spark):
    rows = [(0, [float("nan"), 1.0]), (1, []), (2, [float("-inf"), -5.0])]
    out = {r["k"]: r["b"] for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", tensors.best(F.col("x")).alias("b")).collect()}
    assert out == {0: 1.0, 1: -math.inf, 2: -5.0}


def test_rounding_at_ties(spark):
    x = [127.0, 0.5, 1.5, 2.5, -0.5, -1.5, -127.0]
    df = spark.createDataFrame([(x,)], "x array<double>").select(tensors.quantize_block("x").alias("a"), tensors.quantize_block("x", even=True).alias("e"))
    r = df.first()
    assert r["a"]["q"] == [127, 1, 2, 3, -1, -2, -127] and r["e"]["q"] == [127, 0, 2, 2, 0, -2, -127]


def test_rope_frequencies_without_betas_are_stretched_evenly():
    plain = tensors.rope_frequencies(8, 1e4)
    assert tensors.rope_frequencies(8, 1e4, 4.0, 64, 0.0, 0.0, 1.0) == pytest.approx(plain)
    assert tensors.rope_frequencies(8, 1e4, 4.0) == pytest.approx([f / 4 for f in plain])
    assert tensors.magnitude(16, 1, 1) == 1


def test_strict_rendering_fails(spark):
    turns = spark.createDataFrame([(1, 0, "tool", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception):  # noqa: B017
        text.render_conversations(turns, strict=True).collect()
    assert text.render_conversations(turns).first()["error"] == "unknown role: tool"


def test_split_markers_keeps_every_character(spark):
    from gavel.functions import text as T

    texts = ["a\ue000b", "", "[INST]x[/INST]\n", "[INST][INST]", "plain \U0001f6a8", "x" * 200_000 + "[INST]" + "y\n" * 100_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["p"] for r in df.select("k", T.split_markers("t").alias("p")).collect()}
    assert got[0] == ["a\ue000b"] and got[1] == [] and got[2] == ["[INST]", "x", "[/INST]", "\n"] and got[3] == ["[INST]", "[INST]"]
    assert all("".join(got[i]) == t for i, t in enumerate(texts) if t is not None) and len(got[5]) == 3


def test_encoders_round_trip():
    from gavel.functions.quant import decode, encode

    x = np.random.default_rng(1).standard_normal((50, 32)).astype(np.float32)
    x[3] = 0
    span = x.max(1, keepdims=True) - x.min(1, keepdims=True)
    top = np.abs(x).max(1, keepdims=True)
    for kind, step in {"Q4_1": span / 15, "Q5_1": span / 31, "Q5_0": top / 16, "Q4_0": top / 8, "Q8_0": top / 127, "MXFP4": top / 2}.items():
        y = decode(kind, encode(kind, x.ravel())).reshape(x.shape)
        assert (np.abs(x - y) <= step * 1.03 + 1e-3 * top).all() and (y[3] == 0).all(), kind
        again = decode(kind, encode(kind, y.ravel())).reshape(x.shape)
        assert np.allclose(again, y, atol=float(top.max()) * 2e-3), kind

"""Files, the forward pass, the prefix, moderation, streams and the command line."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel import cli
from gavel.functions.quant import decode, encode
from gavel.operators.model import Cache, Config, Model, Moderator, Prefix, attend
from gavel.operators.moderate import activations, moderate, verdict_logits
from gavel.operators.tiny import write_tiny_model
from gavel.sources import register
from gavel.sources.gguf import GgufError, GgufFile, write_gguf
from gavel.sources.safetensors import load, save


def test_hand_built_file(tmp_path):
    p = str(tmp_path / "a.gguf")
    x = np.arange(6, dtype=np.float32)
    write_gguf(p, {"general.architecture": ("string", "é"), "n": ("uint32", 7), "s": ("float32", 0.5), "flag": ("bool", True), "list": ("array[string]", ["a", "bc"]), "ints": ("array[int32]", [1, -2])}, [("t", (3, 2), "F32", encode("F32", x)), ("u", (32, 1), "Q8_0", encode("Q8_0", np.ones(32)))])
    f = GgufFile(p)
    assert f.text("general.architecture") == "é" and f.get("n") == 7 and f.get("flag") is True and f.get("list") == ["a", "bc"] and f.get("ints") == [1, -2]
    assert f.get("none", 3) == 3 and f.text("n", "d") == "d"
    np.testing.assert_array_equal(f.values("t"), x.reshape(2, 3))
    assert f.values("u").ravel() == pytest.approx(np.ones(32), rel=1e-3)
    with pytest.raises(KeyError):
        f.tensor("none")
    raw = open(p, "rb").read()
    for bad in (raw[:-70], raw[:20], b"nope" + raw[4:], b""):
        open(p, "wb").write(bad)
        with pytest.raises((GgufError, ValueError)):
            GgufFile(p)


def test_source_views(spark, tiny_model):
    register(spark)
    read = lambda view: spark.read.format("gguf").option("path", tiny_model).option("view", view).load()
    assert read("metadata").filter("key = 'general.architecture'").first()["value"] == "mistral3"
    tensors = {r["name"]: r for r in read("tensors").collect()}
    assert tensors["blk.0.attn_q.weight"]["shape"] == [64, 128]
    rows = read("rows").filter("tensor = 'blk.0.attn_q.weight'").orderBy("row_id").collect()
    assert len(rows) == 128
    whole = GgufFile(tiny_model).values("blk.0.attn_q.weight")
    np.testing.assert_array_equal(np.stack([decode("Q8_0", bytes(r["packed"])) for r in rows]), whole)


def test_safetensors(spark, tmp_path):
    p = str(tmp_path / "a.safetensors")
    save(p, {"w": np.arange(6, dtype=np.float32).reshape(2, 3)})
    register(spark)
    r = spark.read.format("safetensors").option("path", p).load().first()
    assert r["shape"] == [2, 3] and r["data"] == [0, 1, 2, 3, 4, 5]
    np.testing.assert_array_equal(load(p, "w"), np.arange(6).reshape(2, 3))


def _plain_logits(model, tokens):
    """The forward pass again, one position and one number after the other."""
    c, f = model.config, model.file
    W = {t.name: f.values(t.name).astype(float) for t in f.tensors}
    norm = lambda x, w: [a / math.sqrt(sum(b * b for b in x) / len(x) + c.eps) * g for a, g in zip(x, W[w].ravel(), strict=True)]
    mul = lambda w, x: [sum(a * b for a, b in zip(row, x, strict=True)) for row in W[w]]
    keys = [[] for _ in range(c.layers)]
    values = [[] for _ in range(c.layers)]
    for pos, token in enumerate(tokens):
        x = list(W["token_embd.weight"][token])

        def turn(v, pos=pos):
            v = list(v)
            for h in range(len(v) // c.head_dim):
                for i, fr in enumerate(c.frequencies):
                    a, b, j = v[h * c.head_dim + 2 * i], v[h * c.head_dim + 2 * i + 1], h * c.head_dim + 2 * i
                    v[j], v[j + 1] = (a * math.cos(pos * fr) - b * math.sin(pos * fr)) * c.rope_scale, (a * math.sin(pos * fr) + b * math.cos(pos * fr)) * c.rope_scale
            return v

        heat = 1 + c.temperature * math.log(1 + pos // c.temperature_context)
        for b in range(c.layers):
            h = norm(x, f"blk.{b}.attn_norm.weight")
            q = [heat * a for a in turn(mul(f"blk.{b}.attn_q.weight", h))]
            keys[b].append(turn(mul(f"blk.{b}.attn_k.weight", h)))
            values[b].append(mul(f"blk.{b}.attn_v.weight", h))
            out = []
            for head in range(c.heads):
                g, d = head // (c.heads // c.kv_heads), c.head_dim
                s = [sum(q[head * d + i] * k[g * d + i] for i in range(d)) / math.sqrt(d) for k in keys[b]]
                e = [math.exp(a - max(s)) for a in s]
                out += [sum(w * v[g * d + i] for w, v in zip(e, values[b], strict=True)) / sum(e) for i in range(d)]
            x = [a + o for a, o in zip(x, mul(f"blk.{b}.attn_output.weight", out), strict=True)]
            h = norm(x, f"blk.{b}.ffn_norm.weight")
            gate, up = mul(f"blk.{b}.ffn_gate.weight", h), mul(f"blk.{b}.ffn_up.weight", h)
            x = [a + o for a, o in zip(x, mul(f"blk.{b}.ffn_down.weight", [s / (1 + math.exp(-s)) * u for s, u in zip(gate, up, strict=True)]), strict=True)]
    return mul("token_embd.weight", norm(x, "output_norm.weight"))


def test_forward_equals_plain_loops(tiny_model):
    m = Model(tiny_model)
    tokens = m.vocabulary.encode("yes, the " + "ab" * 30)
    assert len(tokens) > m.config.temperature_context  # so that queries are warmed
    got = m.forward(tokens, Cache(m.config))
    assert got == pytest.approx(_plain_logits(m, tokens), abs=2e-4)
    split = Cache(m.config, room=2)
    m.forward(tokens[:5], split, prefill=True)
    assert m.forward(tokens[5:], split) == pytest.approx(got, abs=1e-5)
    assert m.forward(tokens, Cache(m.config), rows=[7, 3, 7]) == pytest.approx(got[[7, 3, 7]], abs=1e-6)
    with pytest.raises(IndexError):
        m.forward(tokens, Cache(m.config), rows=[10**6])


def test_cache(tiny_model):
    m = Model(tiny_model)
    c = Cache(m.config, room=1)
    m.forward([5, 6, 7], c, prefill=True)
    state = c.snapshot()
    c.truncate(9)
    assert c.length == 3
    c.truncate(1)
    assert c.length == 1
    c.restore(state)
    assert c.length == 3 and (c.k[:, :, :3] == state[0]).all()
    with pytest.raises(ValueError):
        c.restore((state[0][:1], state[1][:1]))


def test_prefix(tiny_model, tmp_path):
    with_, without = Moderator(tiny_model), Moderator(tiny_model, use_prefix=False)
    p = cli.render("i", "q", "the document")
    a, b = with_.verdict(p), without.verdict(p)
    # float32 sums are rounded in another order when the prefix is not in the same batch
    assert a[:3] == pytest.approx(b[:3], abs=1e-5) and a[4] == len(with_.prefix.tokens) and b[4] == 0
    assert with_.verdict("no prefix")[4] == 0
    path = str(tmp_path / "prefix")
    with_.prefix.save(path)
    assert Prefix.load(path, with_.model).tokens == with_.prefix.tokens
    open(path, "wb").write(b"broken")
    assert Prefix.load(path, with_.model) is None and Prefix.load(path + "no", with_.model) is None
    with_.prefix.fingerprint = "other"
    with pytest.raises(ValueError):
        with_.verdict(p)


def test_config_is_checked(tiny_model, tmp_path):
    f = GgufFile(tiny_model)
    assert Config.of(f).heads == 4
    p = str(tmp_path / "b.gguf")
    write_gguf(p, {"general.architecture": ("string", "bert")}, [])
    with pytest.raises(ValueError):
        Config.of(GgufFile(p))


def test_moderate(spark, tiny_model):
    docs = spark.createDataFrame([(1, "hello"), (2, ""), (3, None)], "doc_id long, text string")
    policies = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "policy_id long, instruct string, query string")
    rows = {(r["doc_id"], r["policy_id"]): r for r in moderate(docs, tiny_model, policies).collect()}
    assert len(rows) == 6 and rows[3, 1]["score"] is None and rows[3, 1]["is_unsafe"] is None
    m = Moderator(tiny_model)
    assert rows[1, 2]["score"] == pytest.approx(m.verdict(cli.render("c", "d", "hello"))[0], abs=1e-6)
    assert rows[2, 1]["is_unsafe"] == (rows[2, 1]["score"] > 0.5)
    full = verdict_logits(docs, tiny_model).filter("doc_id = 1").first()
    assert int(np.argmax(full["logits"])) == full["top_token"]
    seen = activations(tiny_model, "abc")
    assert {"embeddings", "final_norm", "logits", "output-1"} <= {a["name"] for a in seen}


def test_scores_of_published_cases(spark):
    """The two logits of a published case give its score and its texts; a real model is asked where one is named."""
    from gavel.functions import text as T
    from gavel.functions.tensors import verdict
    from gavel.functions.text import DEFAULT_INSTRUCT, DEFAULT_QUERY

    case = spark.createDataFrame([(32.72747802734375, 26.83439064025879)], "yes double, no double").withColumn("score", verdict(F.col("yes"), F.col("no")))
    zero = F.lit(0)
    row = case.select("score", T.verdict_text("score", "yes", "no").alias("t"), T.verdict_json("score", "yes", "no", F.lit(9), zero, zero, zero).alias("j")).first()
    assert row["score"] == pytest.approx(0.997249140956678, abs=1e-6)
    assert row["t"] == "UNSAFE score=0.997249 (yes=32.7275 no=26.8344)"
    assert json.loads(row["j"]) == {"score": 0.9972, "unsafe_verdict": True, "yes_logit": 32.7275, "no_logit": 26.8344, "prompt_tokens": 9, "prefilled_tokens": 0, "load_ms": 0, "inference_ms": 0}
    if path := os.environ.get("GAVEL_MODEL"):
        assert Moderator(path).verdict(cli.render(DEFAULT_INSTRUCT, DEFAULT_QUERY, "How do I bake bread?"))[0] < 0.05


def test_stream(spark, tiny_model, tmp_path):
    from gavel.streaming.moderate import moderate_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        moderate_stream(spark, src, out, str(tmp_path / "check"), tiny_model).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_command_line(tiny_model, capsys):
    assert cli.main(["inspect", tiny_model]) == 0
    types = json.loads(capsys.readouterr().out)["types"]
    assert [t["type"] for t in types] == ["Q8_0", "F32"]
    assert cli.main(["moderate", tiny_model, "--document", "hi", "--json"]) == 0
    assert 0 < json.loads(capsys.readouterr().out)["score"] < 1
    assert cli.main(["tokenize", tiny_model, "yes"]) == 0 and cli.main(["bench", tiny_model]) == 0 and cli.main(["dump", tiny_model, "a"]) == 0
    assert cli.main(["inspect", "/none"]) == 1 and cli.main(["what"]) == 2


def test_download(tmp_path):
    import http.server
    import threading

    from gavel.sources.download import delay, fetch

    body, state = os.urandom(50_000), {"cut": 2, "tag": '"a"'}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_HEAD(self):
            self.send_response(405)
            self.end_headers()

        def do_GET(self):
            first = int((self.headers.get("Range") or "bytes=0-").split("=")[1].split("-")[0])
            probe = self.headers.get("Range") == "bytes=0-0"
            data = body[:1] if probe else body[first:]
            self.send_response(206 if self.headers.get("Range") else 200)
            self.send_header("ETag", state["tag"])
            self.send_header("Content-Length", str(len(data)))
            if self.headers.get("Range"):
                self.send_header("Content-Range", f"bytes {first}-{first + len(data) - 1}/{len(body)}")
            self.end_headers()
            if not probe and state["cut"]:
                state["cut"] -= 1
                data = data[: len(data) // 2]
            self.wfile.write(data)

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    path = str(tmp_path / "model.gguf")
    seen = []
    fetch(f"http://127.0.0.1:{server.server_port}/m", path, seen.append, pause=lambda s: None)
    assert open(path, "rb").read() == body and seen[-1].fraction == 1 and not os.path.exists(path + ".download")
    assert fetch("http://127.0.0.1:1/none", path) == path  # what is there is taken
    assert [delay(i) for i in (1, 2, 9)] == [2, 4, 30]
    server.shutdown()


@pytest.mark.parametrize("more", [{}, {"layers": 3, "kv_heads": 4}, {"heads": 6, "kv_heads": 2, "seed": 3}])
def test_prompts_that_end_alike_share_the_first_layer(tmp_path, monkeypatch, more):
    m = Moderator(write_tiny_model(str(tmp_path / "m"), **more))
    text = " ".join(f"the {i} words of on, é😀 and in{i % 7}" for i in range(90))
    alike = [cli.render(i, q, text) for i, q in (("a", "b"), ("Spam", "Is this an advert?"), ("x" * 70, "y"), ("x" * 69, "z"))]
    for sizes in ({}, {"STRIP": 300, "TILE_POSITIONS": 64, "TILE_KEYS": 40, "RUN": 600}, {"TILE_POSITIONS": 48, "TILE_KEYS": 16}):
        for name, value in sizes.items():
            monkeypatch.setattr(f"gavel.operators.model.{name}", value)
        for use, prompts in ((m, alike), (m, alike[:1]), (m, [alike[0], alike[0]]), (m, [alike[0], alike[1] + "x"]), (Moderator(m.model.file.path, use_prefix=False), alike[1:])):
            for (got, n, held), (want, *counts) in zip(use.logits_alike(prompts), [use.logits(p) for p in prompts], strict=True):
                assert np.allclose(got, want, atol=2e-5) and counts == [n, held]
    monkeypatch.setattr("gavel.operators.model.SAFE_SCORE", 0)  # then each prompt goes by itself
    assert np.allclose(m.logits_alike(alike[:2])[1][0], m.logits(alike[1])[0], atol=2e-5)


def test_scores_of_a_text_are_computed_once_for_all_policies(tiny_model, monkeypatch):
    m, text = Moderator(tiny_model), "some words and more of them " * 120
    prompts = [cli.render(i, q, text) for i, q in (("Hate", "Does this attack a group?"), ("Spam", "Is this an advert?"), ("no", "no"))]
    asked = []
    monkeypatch.setattr("gavel.operators.model.attend", lambda q, k, v, f=attend: asked.append((q.shape[2], k.shape[1])) or f(q, k, v))
    m.logits_alike(prompts)
    # only heads, and the last position of each prompt, go by themselves
    assert len([x for x in asked if x[1] > 1000]) == 3 and sum(a * b for a, b in asked) < m.logits(prompts[0])[1] ** 2 / 20


def test_equal_prompts_are_asked_once():
    import pyarrow as pa

    from gavel.operators.moderate import TOGETHER, _answers

    seen, before = [], [None, []]
    ask = lambda prompts: seen.append(prompts) or [(p, len(seen)) for p in prompts]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(range(len(rows))), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "policy_id", "prompt"])
    rows = [(1, "a"), (1, "b"), (2, None), (2, None), (3, "a"), (3, "b"), (4, "a"), (4, None)]
    assert _answers(batch(rows), ask, before) == [("a", 1), ("b", 1), None, None, ("a", 1), ("b", 1), ("a", 2), None]
    assert _answers(batch([(5, "a")]), ask, before) == [("a", 2)] and seen == [["a", "b"], ["a"]]
    many = [(6, str(i)) for i in range(2 * TOGETHER + 1)]
    assert [x[0] for x in _answers(batch(many), ask, before)] == [p for _, p in many] and len(seen) == 5
    assert _answers(batch([]), ask, before) == []


@pytest.mark.parametrize("size", [1, 60])
def test_attention_in_tiles(monkeypatch, size):
    monkeypatch.setattr("gavel.operators.model.SCORES_AT_ONCE", 640)
    rng = np.random.default_rng(3)
    for n, seen in ((1, 1), (1, 900), (37, 37), (300, 300), (300, 811)):
        q, k, v = (rng.standard_normal((2, *x, 8)).astype(np.float32) for x in ((3, n), (seen,), (seen,)))
        s = np.einsum("ghid,gjd->ghij", (size * q).astype(float), k.astype(float)) / np.sqrt(8) + np.triu(np.full((n, seen), -np.inf), seen - n + 1)
        p = np.exp(s - s.max(-1, keepdims=True))
        want = np.einsum("ghij,gjd->ghid", p / p.sum(-1, keepdims=True), v.astype(float))
        np.testing.assert_allclose(attend((size * q).astype(np.float32), k, v), want, atol=2e-4 if size > 1 else 1e-5)


def test_attention_holds_a_tile_however_many_keys():
    import tracemalloc

    rng = np.random.default_rng(4)
    q, k, v = (rng.standard_normal((1, *x, 8)).astype(np.float32) for x in ((2, 64), (120_000,), (120_000,)))
    tracemalloc.start()
    attend(q, k, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20

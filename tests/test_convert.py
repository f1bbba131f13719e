"""Integer products against floats, and conversion of a checkpoint."""

import base64
import json

import numpy as np
import pytest

from gavel.functions.geometry import BY_NAME, INTEGER
from gavel.functions.integer import Strategy, matmul, quantize
from gavel.functions.quant import decode
from gavel.operators.convert import build_vocabulary, convert, convert_folder, file_name, output_type
from gavel.operators.model import Config, vocabulary_of
from gavel.sources.gguf import GgufFile
from gavel.sources.safetensors import save


@pytest.mark.parametrize("kind", INTEGER)
@pytest.mark.parametrize("even", [False, True])
def test_integer_product_is_near_the_float_one(kind, even):
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, (100 * 8, BY_NAME[kind].size), dtype=np.uint8)
    raw[:, 1] = 0x20 | (raw[:, 1] & 7)
    if kind in ("Q4_1", "Q5_1"):
        raw[:, 3] = 0xA0 | (raw[:, 3] & 3)
    x = rng.standard_normal((13, 256)).astype(np.float32)
    whole = matmul(kind, raw.tobytes(), 100, x, Strategy.INTEGER, even)
    exact = x @ decode(kind, raw.tobytes()).reshape(100, 256).T
    assert np.linalg.norm(whole - exact) / np.linalg.norm(exact) < 0.01
    np.testing.assert_array_equal(whole[3], matmul(kind, raw.tobytes(), 100, x[3:4], Strategy.INTEGER, even)[0])
    np.testing.assert_array_equal(matmul(kind, raw.tobytes(), 100, x), matmul(kind, raw.tobytes(), 100, x, Strategy.INTEGER))


def test_strategies():
    raw = np.zeros(144, np.uint8).tobytes()
    assert matmul("Q4_K", raw, 1, np.ones((1, 256))).tolist() == [[0.0]]
    with pytest.raises(ValueError):
        matmul("Q4_K", raw, 1, np.ones((1, 256)), Strategy.INTEGER)
    q, s = quantize(np.zeros((1, 32)))
    assert not q.any() and not s.any()


def test_convert(tmp_path):
    src, out = str(tmp_path / "a.safetensors"), str(tmp_path / "a.gguf")
    rng = np.random.default_rng(1)
    tensors = {"layers.0.attention.wq.weight": (8, 64), "layers.0.attention_norm.weight": (64,), "layers.0.feed_forward.w2.weight": (4, 33), "norm.weight": (64,), "vision.x.weight": (2, 2)}
    save(src, {k: rng.standard_normal(s).astype(np.float32) for k, s in tensors.items()})
    names = convert(src, out, {"general.architecture": ("string", "llama")})
    f = GgufFile(out)
    assert [(t.name, t.kind.name) for t in f.tensors] == [("blk.0.attn_q.weight", "Q8_0"), ("blk.0.attn_norm.weight", "F32"), ("blk.0.ffn_down.weight", "F16"), ("output_norm.weight", "F32")] and len(names) == 4
    assert f.weight("blk.0.attn_q.weight").shape == (8, 64)
    with pytest.raises(ValueError):
        file_name("layers.1.what.weight")
    assert output_type("x.weight", (2, 64), "f16") == "F16"
    v = build_vocabulary(["<s>", "[INST]"], ["a", "b", "ab"], frozenset({"[INST]"}))
    assert v.types == (3, 4, 1, 1, 1) and v.merges == (("a", "b"),) and v.merge("ab") == [4]


def test_folder(tmp_path):
    """A checkpoint of parameters, tokenizer and tensors becomes a file whose configuration and vocabulary can be read."""
    params = {"max_position_embeddings": 512, "dim": 64, "n_layers": 1, "hidden_dim": 96, "n_heads": 2, "n_kv_heads": 1, "head_dim": 32, "vocab_size": 262, "norm_eps": 1e-5, "rope_theta": 1e6}
    params |= {"yarn": {"factor": 16, "original_max_position_embeddings": 64, "apply_scale": False}, "llama_4_scaling": {"beta": 0.1, "original_max_position_embeddings": 64}}
    special = [{"rank": i, "token_str": t, "is_control": t != "[X]"} for i, t in enumerate(["<unk>", "<s>", "</s>", "[X]"])]
    plain = [bytes([b]) for b in range(256)] + [b"th", b"the"]
    vocab = [{"rank": i, "token_bytes": base64.b64encode(p).decode()} for i, p in enumerate(plain)]
    (tmp_path / "params.json").write_text(json.dumps(params))
    (tmp_path / "tekken.json").write_text(json.dumps({"special_tokens": special[::-1], "vocab": vocab[::-1]}))
    save(str(tmp_path / "consolidated.safetensors"), {"tok_embeddings.weight": np.ones((262, 64), np.float32), "norm.weight": np.ones(64, np.float32), "vision_encoder.x": np.ones(2, np.float32)})
    out = str(tmp_path / "m.gguf")
    assert sorted(convert_folder(str(tmp_path), out)) == ["output_norm.weight", "token_embd.weight"]
    file = GgufFile(out)
    v = vocabulary_of(file)
    assert v.types[:4] == (3, 3, 3, 4) and v.encode("the") == [1, 4 + 257] and v.encode("th") == [1, 4 + 256]
    assert file.get("mistral3.attention.temperature_length") == 64 and file.get("mistral3.rope.scaling.yarn_log_multiplier") == 1
    assert file.get("tokenizer.chat_template", None) is None and Config.of(file).layers == 1
    (tmp_path / "params.json").write_text("{}")
    with pytest.raises(KeyError):
        convert_folder(str(tmp_path), out)

"""From a safetensors checkpoint to a GGUF file: names, types, blocks."""

from __future__ import annotations

import base64
import json
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.bpe import ALPHABET, Vocabulary
from gavel.functions.geometry import parse
from gavel.functions.quant import encode
from gavel.sources.gguf import write_gguf
from gavel.sources.safetensors import header, load

# Names in the checkpoint and in the file.
LAYER = {"attention.wq": "attn_q", "attention.wk": "attn_k", "attention.wv": "attn_v", "attention.wo": "attn_output", "feed_forward.w1": "ffn_gate", "feed_forward.w2": "ffn_down", "feed_forward.w3": "ffn_up", "attention_norm": "attn_norm", "ffn_norm": "ffn_norm"}
TOP = {"norm": "output_norm", "output": "output", "tok_embeddings": "token_embd"}
# Keys of the file and of the checkpoint's parameters.
ARCHITECTURE = "mistral3"
WHOLE = {"context_length": "max_position_embeddings", "embedding_length": "dim", "block_count": "n_layers", "feed_forward_length": "hidden_dim", "attention.head_count": "n_heads", "attention.head_count_kv": "n_kv_heads", "attention.key_length": "head_dim", "attention.value_length": "head_dim", "vocab_size": "vocab_size", "rope.dimension_count": "head_dim"}
REAL = {"attention.layer_norm_rms_epsilon": "norm_eps", "rope.freq_base": "rope_theta"}


def file_name(name: str) -> str | None:
    """The name in the file; None for tensors that don't belong to the text model; an unknown layer tensor is an error."""
    m = re.fullmatch(r"layers\.(\d+)\.(.+)\.weight", name)
    if m:
        if m[2] not in LAYER:
            raise ValueError(f"unknown tensor {name}")
        return f"blk.{m[1]}.{LAYER[m[2]]}.weight"
    top = TOP.get(name.removesuffix(".weight"))
    return f"{top}.weight" if top else None


def output_type(name: str, shape: tuple[int, ...], asked: str) -> str:
    """Norms and vectors stay F32; rows that are no whole blocks become F16."""
    kind = parse(asked)
    if kind is None:
        raise ValueError(f"unknown type {asked}")
    if not kind.quantized:
        return kind.name
    if name.endswith("norm.weight") or len(shape) != 2:
        return "F32"
    return kind.name if shape[-1] % kind.elements == 0 else "F16"


def file_names(name: Column, strict: bool = False) -> Column:
    """file_name as a column expression; an unknown layer tensor is null, or an error in strict mode."""
    of = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    layer, rest = F.regexp_extract(name, r"^layers\.(\d+)\.(.+)\.weight$", 1), F.regexp_extract(name, r"^layers\.(\d+)\.(.+)\.weight$", 2)
    known = F.concat(F.lit("blk."), layer, F.lit("."), of(LAYER)[rest], F.lit(".weight"))
    if strict:
        known = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown tensor "), name)).cast("string"))
    return F.when(layer != "", known).otherwise(F.concat(of(TOP)[F.regexp_replace(name, r"\.weight$", "")], F.lit(".weight")))


def output_types(name: Column, rows: Column, cols: Column, asked: Column, elements: Column) -> Column:
    """output_type as a column expression; elements: those of a block of the type asked for."""
    return F.when(elements == 1, asked).when(name.endswith("norm.weight") | (rows == 1), "F32").when(cols % elements != 0, "F16").otherwise(asked)


def build_vocabulary(special: list[str], ranked: list[str], user_defined: frozenset[str] = frozenset()) -> Vocabulary:
    """Special pieces first, then ranked ones; merges derived from the order of the latter."""
    from gavel.functions.bpe import CONTROL, USER_DEFINED, derive_merges

    types = [USER_DEFINED if s in user_defined else CONTROL for s in special] + [1] * len(ranked)
    return Vocabulary((*special, *ranked), tuple(types), tuple(derive_merges(ranked)))


def convert(source: str, target: str, metadata: dict[str, tuple[str, object]], kind: str = "Q8_0") -> list[str]:
    """Write all text tensors of source, and metadata, to target; returns the names written."""
    tensors = []
    for name in header(source)[0]:
        new = file_name(name) if name != "__metadata__" else None
        if new is None:
            continue
        x = load(source, name)
        own = output_type(new, x.shape, kind)
        tensors.append((new, tuple(reversed(x.shape)), own, encode(own, x)))
    write_gguf(target, metadata, tensors)
    return [t[0] for t in tensors]


def read_vocabulary(tokenizer: dict) -> Vocabulary:
    """Of a tokenizer file: special tokens by rank, then pieces by rank, their bytes in base64."""
    by_rank = lambda xs: sorted(xs, key=lambda x: x["rank"])
    special = by_rank(tokenizer["special_tokens"])
    ranked = ["".join(ALPHABET[b] for b in base64.b64decode(x["token_bytes"])) for x in by_rank(tokenizer["vocab"])]
    return build_vocabulary([x["token_str"] for x in special], ranked, frozenset(x["token_str"] for x in special if not x.get("is_control", True)))


def read_params(params: dict, vocabulary: Vocabulary, chat_template: str | None = None) -> dict[str, tuple[str, object]]:
    """The file's metadata from a checkpoint's parameters; a parameter that is missing is an error."""
    own = {key: ("uint32", int(params[name])) for key, name in WHOLE.items()} | {key: ("float32", float(params[name])) for key, name in REAL.items()}
    if yarn := params.get("yarn"):
        own |= {"rope.scaling.type": ("string", "yarn"), "rope.scaling.original_context_length": ("uint32", int(yarn["original_max_position_embeddings"]))}
        reals = {"factor": yarn["factor"], "yarn_beta_fast": yarn.get("beta", 32), "yarn_beta_slow": yarn.get("alpha", 1), "yarn_ext_factor": 1, "attn_factor": 1, "mscale": 1, "yarn_log_multiplier": 0 if yarn.get("apply_scale") else 1}
        own |= {f"rope.scaling.{key}": ("float32", float(x)) for key, x in reals.items()}
    if warm := params.get("llama_4_scaling"):
        own |= {"attention.temperature_scale": ("float32", float(warm["beta"])), "attention.temperature_length": ("uint32", int(warm["original_max_position_embeddings"]))}
    out = {"general.architecture": ("string", ARCHITECTURE)} | {f"{ARCHITECTURE}.{key}": x for key, x in own.items()}
    words = {"model": ("string", "gpt2"), "pre": ("string", "tekken"), "tokens": ("array[string]", list(vocabulary.pieces)), "token_type": ("array[int32]", list(vocabulary.types)), "merges": ("array[string]", [" ".join(m) for m in vocabulary.merges])}
    words |= {"bos_token_id": ("uint32", 1), "eos_token_id": ("uint32", 2), "unknown_token_id": ("uint32", 0), "padding_token_id": ("uint32", 11), "add_bos_token": ("bool", True), "add_eos_token": ("bool", False)}
    out |= {f"tokenizer.ggml.{key}": x for key, x in words.items()}
    return out | {"tokenizer.chat_template": ("string", chat_template)} if chat_template else out


def convert_folder(folder: str, target: str, kind: str = "Q8_0") -> list[str]:
    """A checkpoint's folder (params.json, tekken.json, consolidated.safetensors, a template if it has one) to one file."""

    def held(name: str) -> str:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return f.read()

    template = held("chat_template.jinja") if os.path.exists(os.path.join(folder, "chat_template.jinja")) else None
    metadata = read_params(json.loads(held("params.json")), read_vocabulary(json.loads(held("tekken.json"))), template)
    return convert(os.path.join(folder, "consolidated.safetensors"), target, metadata, kind)

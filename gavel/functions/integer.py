"""Products of packed weights and activations in integers: codes of both sides, scales, and offsets.

y = sum over blocks of s_w * s_a * (sum of w * a) + m * s_a * (sum of a); whole
tensors at once, in 32-bit integers, so the result doesn't depend on how rows or tokens are batched.
"""

from __future__ import annotations

from enum import Enum

import numpy as np

from gavel.functions.geometry import BY_NAME, INTEGER
from gavel.functions.quant import _half, _nibbles, _u, decode


class Strategy(Enum):
    AUTO = "auto"
    FLOAT = "float"
    INTEGER = "integer"


def quantize(x: np.ndarray, even: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scales) of tokens x columns in blocks of 32.

    Codes come from the unrounded scale; half away from zero with scales kept as halves, or
    half to even with scales kept as they are.
    """
    b = np.asarray(x, np.float32).reshape(len(x), -1, 32)
    d = np.abs(b).max(2) / np.float32(127)
    y = np.divide(b, d[:, :, None], out=np.zeros_like(b), where=d[:, :, None] > 0)
    q = np.rint(y) if even else np.sign(y) * np.floor(np.abs(y) + np.float32(0.5))
    return np.clip(q, -127, 127).astype(np.int32), d if even else d.astype(np.float16).astype(np.float32)


def unpack(kind: str, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signed codes, scale, offset) of each block."""
    if kind not in INTEGER:
        raise ValueError(f"no integer product for {kind}")
    b = np.frombuffer(raw, np.uint8).reshape(-1, BY_NAME[kind].size)
    scale = _half(b, 0)[:, 0]
    if kind == "Q8_0":
        return b[:, 2:].view(np.int8).astype(np.int32), scale, np.zeros_like(scale)
    offset = kind in ("Q4_1", "Q5_1")
    at = 4 if offset else 2
    if kind.startswith("Q5"):
        q = _nibbles(b[:, at + 4 :]) | (((_u(b, at, "<u4") >> np.arange(32, dtype=np.uint32)) & 1) << 4).astype(np.int32)
    else:
        q = _nibbles(b[:, at:])
    if offset:
        return q, scale, _half(b, 2)[:, 0]
    return q - (16 if kind == "Q5_0" else 8), scale, np.zeros_like(scale)


def matmul(kind: str, raw: bytes, rows: int, x: np.ndarray, strategy: Strategy = Strategy.AUTO, even: bool = False, sums: type = np.float32) -> np.ndarray:
    """tokens x rows, added up in the type sums; integers where the type has them and columns are whole blocks, unless floats are asked for."""
    x = np.atleast_2d(np.asarray(x, np.float32))
    able = kind in INTEGER and x.shape[1] % 32 == 0
    if strategy is Strategy.INTEGER and not able:
        raise ValueError(f"no integer product for {kind}")
    if strategy is Strategy.FLOAT or not able:
        return x.astype(sums) @ decode(kind, raw).reshape(rows, -1).T.astype(sums)
    w, scale, offset = (a.reshape(rows, -1, *a.shape[1:]) for a in unpack(kind, raw))
    a, s = quantize(x, even)
    out, s, scale, offset = np.zeros((len(x), rows), sums), s.astype(sums), scale.astype(sums), offset.astype(sums)
    for k in range(w.shape[1]):
        out += (a[:, k] @ w[:, k].T).astype(sums) * s[:, k, None] * scale[:, k]
        if offset.any():
            out += (s[:, k] * a[:, k].sum(1))[:, None] * offset[:, k]
    return out

"""Decoders of packed weight blocks, vectorised over blocks, and their encoders.

A decoder gets all blocks of a batch as one matrix of bytes (blocks x size) and
returns a matrix of values; every field is a slice of columns, every bit field
a broadcast shift, so there is no loop over elements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gavel.functions.geometry import BY_NAME

# Two 16-value codebooks.
IQ4_VALUES = np.array([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113], np.float32)
MXFP4_VALUES = np.array([0, 1, 2, 3, 4, 6, 8, 12, 0, -1, -2, -3, -4, -6, -8, -12], np.float32)

#: Values decoded at once, so that what is in between stays in the cache.
STEP = 32_768

#: Entries and width of the large codebooks; their values come from outside, see codebook().
GRIDS = {"IQ2_XXS": (256, 8), "IQ2_XS": (512, 8), "IQ2_S": (1024, 8), "IQ3_XXS": (256, 4), "IQ3_S": (512, 4), "IQ1_S": (2048, 8)}


@cache
def codebook(name: str) -> np.ndarray:
    """From an installed gguf package; else a made-up one from a rule, good for testing bit layouts only."""
    rows, width = GRIDS[name]
    try:
        from gguf import quants

        cls = getattr(quants, name)
        cls.init_grid()
        return np.asarray(cls.grid, np.float32).reshape(rows, width)
    except ImportError:
        i, t = np.indices((rows, width))
        return ((i * 31 + t * 17) % 43 - 21).astype(np.float32)


def _u(b: np.ndarray, at: int, kind: str, n: int = 1) -> np.ndarray:
    """n little-endian numbers at a byte offset of each block."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(b[:, at : at + n * size]).view(kind)


def _half(b: np.ndarray, at: int) -> np.ndarray:
    return _u(b, at, "<f2").astype(np.float32)


def _nibbles(q: np.ndarray) -> np.ndarray:
    """All low nibbles, then all high ones."""
    return np.concatenate([q & 15, q >> 4], axis=-1).astype(np.int32)


def _codes(q: np.ndarray) -> np.ndarray:
    """All low nibbles, then all high ones, as bytes: they become floats in the one step that scales them."""
    k = q.shape[-1]
    out = np.empty((*q.shape[:-1], 2 * k), np.uint8)
    np.bitwise_and(q, 15, out=out[..., :k])
    np.right_shift(q, 4, out=out[..., k:])
    return out


def _less(codes: np.ndarray, by: int) -> np.ndarray:
    codes -= np.uint8(by)
    return codes.view(np.int8)


def _looked_up(q: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of a 16-entry codebook, in the order of _codes."""
    codes = _codes(q)
    return np.frombuffer(codes.tobytes().translate(values.astype(np.int8).tobytes().ljust(256, b"\0")), np.int8).reshape(codes.shape)


def _bits(x: np.ndarray, n: int) -> np.ndarray:
    return (x[..., None] >> np.arange(n)) & 1


def _scalar(kind: str) -> Callable:
    return lambda b: _u(b, 0, kind).astype(np.float32)


def _bf16(b):
    return (_u(b, 0, "<u2").astype(np.uint32) << 16).view(np.float32)


def _q4(at: int, offset: bool):
    def f(b):
        c = _codes(b[:, at:])
        if not offset:
            return _half(b, 0) * _less(c, 8)
        x = _half(b, 0) * c
        return np.add(x, _half(b, 2), out=x)

    return f


def _q5(at: int, offset: bool):
    def f(b):
        c = _codes(b[:, at + 4 :])
        c |= np.unpackbits(b[:, at : at + 4], axis=1, bitorder="little") << 4
        if not offset:
            return _half(b, 0) * _less(c, 16)
        x = _half(b, 0) * c
        return np.add(x, _half(b, 2), out=x)

    return f


def _q8(at: int):
    return lambda b: _half(b, 0) * b[:, at : at + 32].view(np.int8)


def _two_bits(q: np.ndarray) -> np.ndarray:
    """64 bytes to 256 values: of each half, four planes of 32."""
    q = q.reshape(len(q), 2, 1, 32)
    return ((q >> (2 * np.arange(4))[:, None]) & 3).reshape(len(q), 256).astype(np.int32)


def _q2_k(b):
    scale, q = b[:, :16], _two_bits(b[:, 16:80])
    each = lambda x: np.repeat(x.astype(np.float32), 16, axis=1)
    return _half(b, 80) * each(scale & 15) * q - _half(b, 82) * each(scale >> 4)


def _q3_k(b):
    low = np.concatenate([b[:, 96:104] & 15, b[:, 96:104] >> 4], 1).astype(np.int32)
    high = ((b[:, None, 104:108] >> (2 * np.arange(4))[:, None]) & 3).reshape(len(b), 16).astype(np.int32)
    scale = (low | (high << 4)) - 32
    clear = 1 - ((b[:, None, :32] >> np.arange(8)[:, None]) & 1).reshape(len(b), 256).astype(np.int32)
    return _half(b, 108) * np.repeat(scale, 16, 1) * (_two_bits(b[:, 32:96]) - 4 * clear)


def _six_bits(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight scales and eight minima of six bits from twelve bytes."""
    a, m, x = p[:, :4], p[:, 4:8], p[:, 8:]
    scale = np.concatenate([a & 63, (x & 15) | ((a >> 2) & 48)], 1)
    least = np.concatenate([m & 63, (x >> 4) | ((m >> 2) & 48)], 1)
    return scale.astype(np.float32), least.astype(np.float32)


def _q45_k(fifth: bool):
    def f(b):
        scale, least = _six_bits(b[:, 4:16])
        at = 48 if fifth else 16
        c = _codes(b[:, at : at + 128].reshape(len(b), 4, 32)).reshape(len(b), 8, 32)
        if fifth:
            c |= ((b[:, None, 16:48] >> np.arange(8, dtype=np.uint8)[:, None]) & 1) << 4
        x = (_half(b, 0) * scale)[:, :, None] * c
        x -= (_half(b, 2) * least)[:, :, None]
        return x.reshape(len(b), 256)

    return f


def _q6_k(b):
    c = _codes(b[:, :128].reshape(len(b), 2, 64)).reshape(len(b), 2, 4, 32)
    c |= ((b[:, 128:192].reshape(len(b), 2, 1, 32) >> (2 * np.arange(4, dtype=np.uint8))[:, None]) & 3) << 4
    scale = _half(b, 208) * b[:, 192:208].view(np.int8)
    return (scale[:, :, None] * _less(c, 32).reshape(len(b), 16, 16)).reshape(len(b), 256)


def signs(mask: np.ndarray) -> np.ndarray:
    """Eight factors for each byte: a set bit negates."""
    return (1 - 2 * _bits(mask, 8)).astype(np.float32)


def seven_bit_signs(i: np.ndarray) -> np.ndarray:
    """Seven stored bits; the eighth makes the number of set bits even."""
    return i | ((_bits(i, 7).sum(-1) & 1) << 7)


def _iq2_xxs(b):
    w = _u(b, 2, "<u4", 16).reshape(len(b), 8, 2)
    grid = codebook("IQ2_XXS")[(w[:, :, :1] >> (8 * np.arange(4)).astype(np.uint32)) & 255]
    s = signs(seven_bit_signs(((w[:, :, 1:] >> (7 * np.arange(4)).astype(np.uint32)) & 127).astype(np.int64)))
    d = _half(b, 0) * (0.5 + (w[:, :, 1] >> 28)) * 0.25
    return (d[:, :, None, None] * grid * s).reshape(len(b), 256).astype(np.float32)


def _nibble_scales(p: np.ndarray) -> np.ndarray:
    return np.stack([p & 15, p >> 4], -1).reshape(len(p), -1).astype(np.float32)


def _iq2_xs(b):
    q = _u(b, 2, "<u2", 32)
    d = np.repeat(_half(b, 0) * (0.5 + _nibble_scales(b[:, 66:74])) * 0.25, 2, 1)
    return (d[:, :, None] * codebook("IQ2_XS")[q & 511] * signs(seven_bit_signs((q >> 9).astype(np.int64)))).reshape(len(b), 256)


def _iq2_s(b):
    high = ((b[:, 66:74, None] >> (2 * np.arange(4))) & 3).reshape(len(b), 32).astype(np.int32)
    d = np.repeat(_half(b, 0) * (0.5 + _nibble_scales(b[:, 74:82])) * 0.25, 2, 1)
    return (d[:, :, None] * codebook("IQ2_S")[b[:, 2:34] | (high << 8)] * signs(b[:, 34:66])).reshape(len(b), 256)


def _iq3_xxs(b):
    w = _u(b, 66, "<u4", 8)
    s = signs(seven_bit_signs(((w[:, :, None] >> (7 * np.arange(4)).astype(np.uint32)) & 127).astype(np.int64)))
    d = _half(b, 0) * (0.5 + (w >> 28)) * 0.5
    grid = codebook("IQ3_XXS")[b[:, 2:66]].reshape(len(b), 8, 4, 8)
    return (d[:, :, None, None] * grid * s).reshape(len(b), 256).astype(np.float32)


def _iq3_s(b):
    high = _bits(b[:, 66:74], 8).reshape(len(b), 64).astype(np.int32)
    d = _half(b, 0) * (1 + 2 * _nibble_scales(b[:, 106:110]))
    grid = codebook("IQ3_S")[b[:, 2:66] | (high << 8)].reshape(len(b), 8, 4, 8)
    return (d[:, :, None, None] * grid * signs(b[:, 74:106]).reshape(len(b), 8, 4, 8)).reshape(len(b), 256)


def _iq1_s(b):
    h = _u(b, 34, "<u2", 8).astype(np.int32)
    d = _half(b, 0) * (2 * ((h >> 12) & 7) + 1)
    at = b[:, 2:34].reshape(len(b), 8, 4) | (((h[:, :, None] >> (3 * np.arange(4))) & 7) << 8)
    shift = np.where(h & 0x8000, -0.125, 0.125)[:, :, None, None]
    return (d[:, :, None, None] * (codebook("IQ1_S")[at] + shift)).reshape(len(b), 256).astype(np.float32)


def _iq1_m(b):
    s = _u(b, 48, "<u2", 4).astype(np.int32)
    bits = ((s >> 12) << (4 * np.arange(4))).sum(1).astype(np.uint16)
    d = bits.view(np.float16).astype(np.float32)[:, None] * (2 * ((s[:, :, None] >> (3 * np.arange(4))) & 7) + 1).reshape(len(b), 16)
    h = np.stack([b[:, 32:48] & 15, b[:, 32:48] >> 4], -1).reshape(len(b), 32).astype(np.int32)
    grid = codebook("IQ1_S")[b[:, :32] | ((h & 7) << 8)] + np.where(h & 8, -0.125, 0.125)[:, :, None]
    return (np.repeat(d, 2, 1)[:, :, None] * grid).reshape(len(b), 256).astype(np.float32)


def _iq4_nl(b):
    return _half(b, 0) * _looked_up(b[:, 2:], IQ4_VALUES)


def _iq4_xs(b):
    high = (_u(b, 2, "<u2").astype(np.int32) >> (2 * np.arange(8))) & 3
    scale = (_nibble_scales(b[:, 4:8]).astype(np.int32) | (high << 4)) - 32
    q = _looked_up(b[:, 8:].reshape(len(b), 8, 16), IQ4_VALUES)
    return ((_half(b, 0) * scale).astype(np.float32)[:, :, None] * q).reshape(len(b), 256)


def _tq1_0(b):
    power = np.array([1, 3, 9, 27, 81], np.int32)[:, None]
    planes = lambda q, n: ((q[:, None].astype(np.int32) * power[:n]) & 255).reshape(len(b), -1)
    x = np.concatenate([planes(b[:, :32], 5), planes(b[:, 32:48], 5), planes(b[:, 48:52], 4)], 1)
    return _half(b, 52) * (((x * 3) >> 8) - 1)


def _tq2_0(b):
    return _half(b, 64) * (_two_bits(b[:, :64]) - 1)


def half_power(e: np.ndarray) -> np.ndarray:
    """2 ** (e - 128): an exponent byte as a scale, halved."""
    return np.ldexp(np.float32(1), e.astype(np.int32) - 128).astype(np.float32)


def _mxfp4(b):
    return half_power(b[:, :1]) * _looked_up(b[:, 1:], MXFP4_VALUES)


DECODERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "F32": _scalar("<f4"), "F16": _scalar("<f2"), "BF16": _bf16, "F64": _scalar("<f8"), "I8": _scalar("<i1"), "I16": _scalar("<i2"), "I32": _scalar("<i4"), "I64": _scalar("<i8"),
    "Q4_0": _q4(2, False), "Q4_1": _q4(4, True), "Q5_0": _q5(2, False), "Q5_1": _q5(4, True), "Q8_0": _q8(2), "Q8_1": _q8(4),
    "Q2_K": _q2_k, "Q3_K": _q3_k, "Q4_K": _q45_k(False), "Q5_K": _q45_k(True), "Q6_K": _q6_k, "Q8_K": lambda b: _u(b, 0, "<f4") * b[:, 4:260].view(np.int8),
    "IQ2_XXS": _iq2_xxs, "IQ2_XS": _iq2_xs, "IQ2_S": _iq2_s, "IQ3_XXS": _iq3_xxs, "IQ3_S": _iq3_s, "IQ1_S": _iq1_s, "IQ1_M": _iq1_m,
    "IQ4_NL": _iq4_nl, "IQ4_XS": _iq4_xs, "TQ1_0": _tq1_0, "TQ2_0": _tq2_0, "MXFP4": _mxfp4,
}


def decode(kind: str, raw: bytes) -> np.ndarray:
    """All values of packed bytes."""
    t = BY_NAME[kind]
    if len(raw) % t.size:
        raise ValueError(f"{kind}: {len(raw)} bytes are no multiple of {t.size}")
    if not raw:
        return np.zeros(0, np.float32)
    b = np.frombuffer(raw, np.uint8).reshape(-1, t.size)
    out = np.empty((len(b), t.elements), np.float32)
    step = max(1, STEP // t.elements)
    for i in range(0, len(b), step):
        out[i : i + step] = DECODERS[kind](b[i : i + step])
    return out.ravel()


def dequantize(kind: str, packed: Column | str) -> Column:
    """array<float> of packed bytes; whole Arrow batches are decoded at once where their rows have one length."""

    @pandas_udf("array<float>")
    def f(raws: pd.Series) -> pd.Series:
        held = raws.dropna()
        values = decode(kind, b"".join(bytes(x) for x in held))
        t = BY_NAME[kind]
        ends = np.cumsum([len(x) // t.size * t.elements for x in held])[:-1] if len(held) else []
        return pd.Series(np.split(values, ends) if len(held) else [], index=held.index, dtype=object).reindex(raws.index)

    return f(F.col(packed) if isinstance(packed, str) else packed)


def encode_q8_0(x: np.ndarray) -> bytes:
    """Blocks of 32: codes by the scale before it is rounded to half, half away from zero."""
    x = np.asarray(x, np.float32).reshape(-1, 32)
    d = np.abs(x).max(1, keepdims=True) / np.float32(127)
    y = np.divide(x, d, out=np.zeros_like(x), where=d > 0)
    q = np.clip(np.sign(y) * np.floor(np.abs(y) + np.float32(0.5)), -127, 127).astype(np.int8)
    return np.concatenate([d.astype("<f2").view(np.uint8), q.view(np.uint8)], 1).tobytes()


def encode_q4_0(x: np.ndarray) -> bytes:
    """Blocks of 32: the value of greatest size becomes code 0 or 15's neighbour, -8."""
    x = np.asarray(x, np.float32).reshape(-1, 32)
    top = np.take_along_axis(x, np.abs(x).argmax(1)[:, None], 1)
    d = top / np.float32(-8)
    q = np.clip(np.floor(np.divide(x, d, out=np.zeros_like(x), where=d != 0) + np.float32(8.5)), 0, 15).astype(np.uint8)
    return np.concatenate([d.astype("<f2").view(np.uint8), q[:, :16] | (q[:, 16:] << 4)], 1).tobytes()


def _offset_blocks(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, least value and codes 0 to top of blocks of 32, each from its least to its greatest value."""
    least = x.min(1, keepdims=True)
    d = (x.max(1, keepdims=True) - least) / np.float32(top)
    q = np.clip(np.floor(np.divide(x - least, d, out=np.zeros_like(x), where=d > 0) + np.float32(0.5)), 0, top)
    return d, least, q.astype(np.uint8)


def _packed(q: np.ndarray, *head: np.ndarray, fifth: bool = False) -> bytes:
    """Head fields, the fifth bits of the codes if they have them, then their nibbles."""
    parts = [x.astype("<f2").view(np.uint8) for x in head]
    if fifth:
        parts.append(np.packbits(q >> 4, axis=1, bitorder="little"))
    return np.concatenate([*parts, (q[:, :16] & 15) | ((q[:, 16:] & 15) << 4)], 1).tobytes()


def encode_q4_1(x: np.ndarray) -> bytes:
    d, least, q = _offset_blocks(np.asarray(x, np.float32).reshape(-1, 32), 15)
    return _packed(q, d, least)


def encode_q5_1(x: np.ndarray) -> bytes:
    d, least, q = _offset_blocks(np.asarray(x, np.float32).reshape(-1, 32), 31)
    return _packed(q, d, least, fifth=True)


def encode_q5_0(x: np.ndarray) -> bytes:
    """The value of greatest size becomes -16."""
    x = np.asarray(x, np.float32).reshape(-1, 32)
    d = np.take_along_axis(x, np.abs(x).argmax(1)[:, None], 1) / np.float32(-16)
    q = np.clip(np.floor(np.divide(x, d, out=np.zeros_like(x), where=d != 0) + np.float32(16.5)), 0, 31).astype(np.uint8)
    return _packed(q, d, fifth=True)


def encode_mxfp4(x: np.ndarray) -> bytes:
    """A power of two that brings the greatest size to the codebook's top binade; the nearest code, the first of equals."""
    x = np.asarray(x, np.float32).reshape(-1, 32)
    top = np.abs(x).max(1, keepdims=True)
    e = np.clip(np.where(top > 0, np.frexp(top)[1] - 1 - 2 + 127, 0), 0, 254).astype(np.uint8)
    q = np.abs((x / half_power(e))[:, :, None] - MXFP4_VALUES).argmin(2).astype(np.uint8)
    return np.concatenate([e, (q[:, :16] & 15) | (q[:, 16:] << 4)], 1).tobytes()


def encode(kind: str, x: np.ndarray) -> bytes:
    x = np.asarray(x, np.float32).ravel()
    if kind == "F32":
        return x.astype("<f4").tobytes()
    if kind == "F16":
        return x.astype("<f2").tobytes()
    if kind == "BF16":
        return ((x.view(np.uint32) + 0x7FFF + ((x.view(np.uint32) >> 16) & 1)) >> 16).astype("<u2").tobytes()
    blocks = {"Q8_0": encode_q8_0, "Q4_0": encode_q4_0, "Q4_1": encode_q4_1, "Q5_0": encode_q5_0, "Q5_1": encode_q5_1, "MXFP4": encode_mxfp4}
    if kind in blocks:
        return blocks[kind](x)
    raise ValueError(f"no encoder for {kind}")

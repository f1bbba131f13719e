"""Queries of the block decoders and encoders, each with SQL that reads the bytes one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.geometry import BY_NAME
from gavel.functions.quant import IQ4_VALUES, MXFP4_VALUES, dequantize
from gavel.functions.tensors import doubles, dot, quantize_block, rounded

#: Elements of one row of an unpacked type.
SCALARS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fixed_digits(name: str) -> list[tuple[int, str]]:
    """(place of a hex digit, digits) that keep a block's scales finite and of ordinary size."""
    half = lambda at: [(2 * (at + 1) + 1, "2")]
    at = {"Q2_K": (80, 82), "Q3_K": (108,), "Q4_K": (0, 2), "Q5_K": (0, 2), "Q6_K": (208,), "TQ1_0": (52,), "TQ2_0": (64,), "Q4_1": (0, 2), "Q5_1": (0, 2)}
    if name in ("I8", "I16", "I32", "I64"):
        return []
    if name == "F16":
        return [x for i in range(SCALARS) for x in half(2 * i)]
    if name in ("F32", "BF16", "F64"):
        size = BY_NAME[name].size
        return [(2 * (size * i + size - 1) + 1, "3f") for i in range(SCALARS)]
    if name == "Q8_K":
        return [(7, "3f")]
    if name == "MXFP4":
        return [(1, "7")]
    if name == "IQ1_M":
        return [(2 * 55 + 1, "2")]
    return [x for o in at.get(name, (0,)) for x in half(o)]


def _width(name: str) -> tuple[int, int]:
    """Bytes and values of a query's row."""
    t = BY_NAME[name]
    return (t.size, t.elements) if t.quantized else (t.size * SCALARS, SCALARS)


def blocks(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, packed): bytes made of digests, one block for each document."""
    size, _ = _width(name)
    digests = [F.sha2(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(name), F.lit(str(k))).cast("binary"), 256) for k in range(-(-size // 32))]
    digits = F.substring(F.concat(*digests), 1, 2 * size)
    for at, new in _fixed_digits(name):
        digits = F.overlay(digits, F.lit(new), at, len(new))
    return docs.select("doc_id", F.unhex(digits).alias("packed"))


def _dequant(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = blocks(_table(spark, sf_dir, "documents"), name).select("doc_id", dequantize(name, "packed").alias("v"))
        v = v.select("doc_id", doubles("v").alias("v"))
        weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        return v.select("doc_id", rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("v_sum"), rounded(weighted, 2).alias("v_weighted"), rounded(F.col("v")[0], 3).alias("v_first"), rounded(F.element_at("v", -1), 3).alias("v_last"))

    query.__name__ = f"dequant_{name.lower()}"
    return query


def _b(i) -> str:
    return f"b[({i}) + 1]"


def _u16(o) -> str:
    return f"({_b(o)} + 256 * {_b(f'{o} + 1')})"


def _u32(o) -> str:
    return "(" + " + ".join(f"{256**k}::BIGINT * {_b(f'{o} + {k}')}" for k in range(4)) + ")"


def _half_of(h: str) -> str:
    return f"((1 - 2 * ({h} >> 15)) * CASE WHEN (({h} >> 10) & 31) = 0 THEN ({h} & 1023) * pow(2, -24) ELSE (1 + ({h} & 1023) / 1024.0::DOUBLE) * pow(2, (({h} >> 10) & 31) - 15) END)"


def _half(o) -> str:
    return _half_of(_u16(o))


def _single(w: str) -> str:
    return f"((1 - 2 * ({w} >> 31)) * (1 + ({w} & 8388607) / 8388608.0::DOUBLE) * pow(2, (({w} >> 23) & 255) - 127))"


def _i8(x: str) -> str:
    return f"({x} - 256 * ({x} >> 7))"


def _nibble(at: int) -> str:
    return f"(({_b(f'{at} + e % 16')} >> (4 * (e // 16))) & 15)"


def _plane(at: int) -> str:
    """Two bits of a value, from four planes of 32 in each half."""
    return f"(({_b(f'{at} + (e // 128) * 32 + e % 32')} >> (2 * ((e // 32) % 4))) & 3)"


def _nib_scale(at: int, i: str) -> str:
    return f"(({_b(f'{at} + ({i}) // 2')} >> (4 * (({i}) % 2))) & 15)"


def _grid(i: str, t: str) -> str:
    return f"((({i}) * 31 + ({t}) * 17) % 43 - 21)"


def _odd_sign(s: str) -> str:
    """Bit e % 8 of seven bits and their parity, as a factor."""
    return f"(1 - 2 * CASE WHEN e % 8 < 7 THEN (({s}) >> (e % 8)) & 1 ELSE bit_count(({s})::INTEGER) % 2 END)"


def _sign(x: str) -> str:
    return f"(1 - 2 * (({x} >> (e % 8)) & 1))"


_SB = "(e // 32)"
_SCALE6 = f"CASE WHEN {_SB} < 4 THEN {_b(f'4 + {_SB}')} & 63 ELSE ({_b(f'8 + {_SB}')} & 15) | (({_b(f'{_SB}')} >> 2) & 48) END"
_MIN6 = f"CASE WHEN {_SB} < 4 THEN {_b(f'8 + {_SB}')} & 63 ELSE ({_b(f'8 + {_SB}')} >> 4) | (({_b(f'4 + {_SB}')} >> 2) & 48) END"
_K3 = "(e // 16)"
_J6 = "(e % 64)"
_HALF6 = "((e % 128) // 64)"
_W1 = _u32("2 + (e // 32) * 8 + 4")
_W3 = _u32("66 + (e // 32) * 4")
_QX = _u16("2 + (e // 8) * 2")
_QH = _u16("34 + (e // 32) * 2")
_M = "(e // 8)"
_SM = _u16(f"48 + 2 * ({_M} // 8)")
_NM = f"(({_b(f'32 + {_M} // 2')} >> (4 * ({_M} % 2))) & 15)"
_KS = "((e % 32) // 8)"
_TQ = "CASE WHEN e < 160 THEN ({} * (3 ** (e // 32))::BIGINT) WHEN e < 240 THEN ({} * (3 ** ((e - 160) // 16))::BIGINT) ELSE ({} * (3 ** ((e - 240) // 4))::BIGINT) END".format(_b("e % 32"), _b("32 + (e - 160) % 16"), _b("48 + (e - 240) % 4"))
_LIST = lambda v: "[" + ", ".join(str(int(x)) for x in v) + "]"


def _integer(size: int) -> str:
    low = [f"{256**k}::BIGINT * {_b(f'{size} * e + {k}')}" for k in range(size - 1)]
    return " + ".join([*low, f"{256 ** (size - 1)}::BIGINT * {_i8(_b(f'{size} * e + {size - 1}'))}"])


def _double_bits() -> str:
    high = f"({_b('8 * e + 7')} * 256 + {_b('8 * e + 6')})"
    low = " + ".join([f"({high} & 15)::BIGINT * {256**6}", *[f"{256**k}::BIGINT * {_b(f'8 * e + {k}')}" for k in range(6)]])
    return f"((1 + ({low}) / {2**52}.0::DOUBLE) * pow(2, (({high} >> 4) & 2047) - 1023))"


#: Value e of a block whose bytes are b, whose scale is d and whose minimum is m.
FORMULAS: dict[str, tuple[str, str, str]] = {
    "F32": ("0", "0", _single(_u32("4 * e"))),
    "F16": ("0", "0", _half("2 * e")),
    "BF16": ("0", "0", _single(f"({_u16('2 * e')}::BIGINT * 65536)")),
    "F64": ("0", "0", _double_bits()),
    "I8": ("0", "0", _integer(1)),
    "I16": ("0", "0", _integer(2)),
    "I32": ("0", "0", _integer(4)),
    "I64": ("0", "0", _integer(8)),
    "Q4_0": (_half(0), "0", f"d * ({_nibble(2)} - 8)"),
    "Q4_1": (_half(0), _half(2), f"d * {_nibble(4)} + m"),
    "Q5_0": (_half(0), "0", f"d * (({_nibble(6)} | ((({_b('2 + e // 8')} >> (e % 8)) & 1) << 4)) - 16)"),
    "Q5_1": (_half(0), _half(2), f"d * ({_nibble(8)} | ((({_b('4 + e // 8')} >> (e % 8)) & 1) << 4)) + m"),
    "Q8_0": (_half(0), "0", f"d * {_i8(_b('2 + e'))}"),
    "Q8_1": (_half(0), "0", f"d * {_i8(_b('4 + e'))}"),
    "Q2_K": (_half(80), _half(82), f"d * ({_b('e // 16')} & 15) * {_plane(16)} - m * ({_b('e // 16')} >> 4)"),
    "Q3_K": (_half(108), "0", f"d * (((({_b(f'96 + {_K3} % 8')} >> (4 * ({_K3} // 8))) & 15) | ((({_b(f'104 + {_K3} % 4')} >> (2 * ({_K3} // 4))) & 3) << 4)) - 32) * ({_plane(32)} - 4 * (1 - (({_b('e % 32')} >> (e // 32)) & 1)))"),
    "Q4_K": (_half(0), _half(2), f"d * ({_SCALE6}) * (({_b('16 + (e // 64) * 32 + e % 32')} >> (4 * ({_SB} % 2))) & 15) - m * ({_MIN6})"),
    "Q5_K": (_half(0), _half(2), f"d * ({_SCALE6}) * ((({_b('48 + (e // 64) * 32 + e % 32')} >> (4 * ({_SB} % 2))) & 15) | ((({_b('16 + e % 32')} >> {_SB}) & 1) << 4)) - m * ({_MIN6})"),
    "Q6_K": (_half(208), "0", f"d * {_i8(_b('192 + e // 16'))} * (((({_b(f'(e // 128) * 64 + {_J6}')} >> (4 * {_HALF6})) & 15) | ((({_b('128 + (e // 128) * 32 + e % 32')} >> (2 * ({_HALF6} * 2 + {_J6} // 32))) & 3) << 4)) - 32)"),
    "Q8_K": (_single(_u32("0")), "0", f"d * {_i8(_b('4 + e'))}"),
    "IQ2_XXS": (_half(0), "0", f"d * (0.5::DOUBLE + ({_W1} >> 28)) * 0.25::DOUBLE * {_grid(_b(f'2 + (e // 32) * 8 + {_KS}'), 'e % 8')} * {_odd_sign(f'({_W1} >> (7 * {_KS})) & 127')}"),
    "IQ2_XS": (_half(0), "0", f"d * (0.5::DOUBLE + {_nib_scale(66, 'e // 16')}) * 0.25::DOUBLE * {_grid(f'{_QX} & 511', 'e % 8')} * {_odd_sign(f'{_QX} >> 9')}"),
    "IQ2_S": (_half(0), "0", f"d * (0.5::DOUBLE + {_nib_scale(74, 'e // 16')}) * 0.25::DOUBLE * {_grid(f'{_b(f"2 + {_M}")} | ((({_b(f"66 + {_M} // 4")} >> (2 * ({_M} % 4))) & 3) << 8)', 'e % 8')} * {_sign(_b(f'34 + {_M}'))}"),
    "IQ3_XXS": (_half(0), "0", f"d * (0.5::DOUBLE + ({_W3} >> 28)) * 0.5::DOUBLE * {_grid(_b('2 + e // 4'), 'e % 4')} * {_odd_sign(f'({_W3} >> (7 * {_KS})) & 127')}"),
    "IQ3_S": (_half(0), "0", f"d * (1 + 2 * {_nib_scale(106, 'e // 32')}) * {_grid(f'{_b("2 + e // 4")} | ((({_b("66 + e // 32")} >> ((e // 4) % 8)) & 1) << 8)', 'e % 4')} * {_sign(_b(f'74 + {_M}'))}"),
    "IQ1_S": (_half(0), "0", f"d * (2 * (({_QH} >> 12) & 7) + 1) * ({_grid(f'{_b(f"2 + {_M}")} | ((({_QH} >> (3 * {_KS})) & 7) << 8)', 'e % 8')} + CASE WHEN {_QH} >= 32768 THEN -0.125::DOUBLE ELSE 0.125::DOUBLE END)"),
    "IQ1_M": (_half_of(f"(({_b(49)} >> 4) + 16 * ({_b(51)} >> 4) + 256 * ({_b(53)} >> 4) + 4096 * ({_b(55)} >> 4))"), "0", f"d * (2 * (({_SM} >> (3 * (({_M} // 2) % 4))) & 7) + 1) * ({_grid(f'{_b(_M)} | (({_NM} & 7) << 8)', 'e % 8')} + CASE WHEN {_NM} >= 8 THEN -0.125::DOUBLE ELSE 0.125::DOUBLE END)"),
    "IQ4_NL": (_half(0), "0", f"d * ({_LIST(IQ4_VALUES)})[{_nibble(2)} + 1]"),
    "IQ4_XS": (_half(0), "0", f"d * (({_nib_scale(4, 'e // 32')} | ((({_u16(2)} >> (2 * (e // 32))) & 3) << 4)) - 32) * ({_LIST(IQ4_VALUES)})[(({_b('8 + (e // 32) * 16 + e % 16')} >> (4 * ((e % 32) // 16))) & 15) + 1]"),
    "TQ1_0": (_half(52), "0", f"d * ((((({_TQ}) & 255) * 3) >> 8) - 1)"),
    "TQ2_0": (_half(64), "0", f"d * ({_plane(0)} - 1)"),
    "MXFP4": (f"pow(2, {_b(0)} - 128)", "0", f"d * ({_LIST(MXFP4_VALUES)})[{_nibble(1)} + 1]"),
}


def _dequant_sql(name: str) -> str:
    size, n = _width(name)
    digits = f"substr({' || '.join(f"sha256(doc_id || '-{name}-{k}')" for k in range(-(-size // 32)))}, 1, {2 * size})"
    steps, last = [f"h0 AS (SELECT doc_id, {digits} h FROM documents)"], 0
    for at, new in _fixed_digits(name):
        steps.append(f"h{last + 1} AS (SELECT doc_id, substr(h, 1, {at - 1}) || '{new}' || substr(h, {at + len(new)}) h FROM h{last})")
        last += 1
    d, m, v = FORMULAS[name]
    return f"""WITH {', '.join(steps)},
bytes AS (SELECT doc_id, list_transform(range({size}), lambda i: (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1) b FROM h{last}),
scales AS (SELECT doc_id, b, {d} d, {m} m FROM bytes),
vals AS (SELECT doc_id, list_transform(range({n}), lambda e: CAST(CAST({v} AS FLOAT) AS DOUBLE)) v FROM scales)
SELECT doc_id, round(list_sum(v), 3) + 0.0 v_sum, round(list_sum(list_transform(range({n}), lambda i: v[i + 1] * (i + 1))), 2) + 0.0 v_weighted, round(v[1], 3) + 0.0 v_first, round(v[{n}], 3) + 0.0 v_last FROM vals"""



def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, part, x): the vectors in blocks of 32."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.select("vec_id", F.posexplode(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("part", "x"))


def _quantize(even: bool) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = _halves(spark, sf_dir).select("vec_id", "part", quantize_block("x", even).alias("b"))
        return q.select("vec_id", "part", F.round("b.d", 6).alias("scale"), F.aggregate("b.q", F.lit(0), lambda a, x: a + x).cast("long").alias("code_sum"), F.aggregate("b.q", F.lit(0), lambda a, x: a + F.abs(x)).cast("long").alias("code_size"))

    query.__name__ = "quantize_q8_even" if even else "quantize_q8_away"
    return query


def _halves_sql() -> str:
    return "SELECT vec_id, p part, (embedding[32 * p + 1 : 32 * p + 32])::DOUBLE[] x FROM embeddings, (SELECT unnest([0, 1])::INTEGER p)"


def _codes_sql(even: bool = False) -> str:
    near = "round_even(x / d, 0)" if even else "round(x / d)"
    return f"SELECT vec_id, part, x v, d, CASE WHEN d = 0 THEN list_transform(x, lambda x: 0) ELSE list_transform(x, lambda x: greatest(-127, least(127, {near}))::INTEGER) END q FROM (SELECT *, list_max(list_transform(x, lambda a: abs(a))) / 127 d FROM ({_halves_sql()}))"


def q8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest error of a vector's blocks, in half steps of their scale."""
    q = _halves(spark, sf_dir).select("vec_id", "part", doubles("x").alias("x"), quantize_block("x").alias("b"))
    worst = F.array_max(F.zip_with("x", "b.q", lambda x, c: F.abs(x - c * F.col("b.d"))))
    return q.select("vec_id", "part", rounded(worst, 6).alias("worst"), (worst <= F.col("b.d") * 0.5 + 1e-9).alias("within_half_step"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside its successor by id."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


def int_dot_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product by codes: for each block the product of the scales times that of the codes."""
    p = _pairs(spark, sf_dir)
    block = lambda c, k: quantize_block(F.slice(c, 1 + 32 * k, 32))
    p = p.select("vec_id", *[block(c, k).alias(f"{c[0]}{k}") for c in ("embedding", "other") for k in (0, 1)])
    return p.select("vec_id", rounded(sum((F.col(f"e{k}.d") * F.col(f"o{k}.d") * dot(f"e{k}.q", f"o{k}.q") for k in (0, 1)), F.lit(0.0))).alias("dot"))


def _codes(w: Column, d: Column, low: Column, zero: float) -> Column:
    return F.transform(w, lambda x: F.when(d == 0, zero).otherwise(F.round((x - low) / d) + zero))


def int_dot_q4_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of four bits with a minimum: the offset meets the sum of the other side's codes."""
    p = _pairs(spark, sf_dir)
    parts = []
    for k in (0, 1):
        w = doubles(F.slice("other", 1 + 32 * k, 32))
        low, high = F.array_min(w), F.array_max(w)
        d = (high - low) / 15
        q = _codes(w, d, low, 0.0)
        parts.append(F.struct(quantize_block(F.slice("embedding", 1 + 32 * k, 32)).alias("a"), d.alias("d"), low.alias("m"), q.alias("q")).alias(f"p{k}"))
    p = p.select("vec_id", *parts)
    one = lambda k: F.col(f"p{k}.d") * F.col(f"p{k}.a.d") * dot(f"p{k}.q", f"p{k}.a.q") + F.col(f"p{k}.m") * F.col(f"p{k}.a.d") * F.aggregate(f"p{k}.a.q", F.lit(0), lambda a, x: a + x)
    return p.select("vec_id", rounded(one(0) + one(1)).alias("dot"))


def gemm_q4_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned codes: the zero point is taken out through the sum of the other side's codes."""
    p = _pairs(spark, sf_dir)
    parts = []
    for k in (0, 1):
        w = doubles(F.slice("other", 1 + 32 * k, 32))
        d = F.array_max(F.transform(w, F.abs)) / 7
        u = _codes(w, d, F.lit(0.0), 8.0)
        parts.append(F.struct(quantize_block(F.slice("embedding", 1 + 32 * k, 32), even=True).alias("a"), d.alias("d"), u.alias("u")).alias(f"p{k}"))
    p = p.select("vec_id", *parts)
    one = lambda k: (dot(f"p{k}.u", f"p{k}.a.q") - 8 * F.aggregate(f"p{k}.a.q", F.lit(0), lambda a, x: a + x)) * F.col(f"p{k}.d") * F.col(f"p{k}.a.d")
    return p.select("vec_id", rounded(one(0) + one(1)).alias("dot"))


def _int_dot_sql(weights: str, value: str) -> str:
    return f"""WITH a AS ({{codes}}), w AS ({weights})
SELECT a.vec_id, round(sum({value} ORDER BY a.part), 4) + 0.0 dot FROM a JOIN w ON w.vec_id = a.vec_id + 1 AND w.part = a.part GROUP BY 1"""


_DOT = "list_dot_product(w.q::DOUBLE[], a.q::DOUBLE[])"
QUERIES = {f"dequant_{k.lower()}": _dequant(k) for k in FORMULAS} | {f.__name__: f for f in (_quantize(False), _quantize(True), q8_round_trip, int_dot_q8, int_dot_q4_1, gemm_q4_0)}
_SUMS = "round(d, 6) scale, list_sum(q)::BIGINT code_sum, list_sum(list_transform(q, lambda x: abs(x)))::BIGINT code_size"
ORACLE_SQL = {f"dequant_{k.lower()}": _dequant_sql(k) for k in FORMULAS} | {
    "quantize_q8_away": f"SELECT vec_id, part, {_SUMS} FROM ({_codes_sql()})",
    "quantize_q8_even": f"SELECT vec_id, part, {_SUMS} FROM ({_codes_sql(True)})",
    "q8_round_trip": f"SELECT vec_id, part, round(worst, 6) + 0.0 worst, worst <= d * 0.5 + 1e-9 within_half_step FROM (SELECT vec_id, part, d, list_max(list_transform(range(32), lambda i: abs(v[i + 1] - q[i + 1] * d))) worst FROM ({_codes_sql()}))",
    "int_dot_q8": _int_dot_sql(_codes_sql(), f"w.d * a.d * {_DOT}").replace("{codes}", _codes_sql()),
    "int_dot_q4_1": _int_dot_sql(
        f"SELECT vec_id, part, d, m, list_transform(x, lambda x: CASE WHEN d = 0 THEN 0 ELSE round((x - m) / d) END) q FROM (SELECT *, list_min(x) m, (list_max(x) - list_min(x)) / 15 d FROM ({_halves_sql()}))",
        f"w.d * a.d * {_DOT} + w.m * a.d * list_sum(a.q)",
    ).replace("{codes}", _codes_sql()),
    "gemm_q4_0": _int_dot_sql(
        f"SELECT vec_id, part, d, list_transform(x, lambda x: CASE WHEN d = 0 THEN 8 ELSE round(x / d) + 8 END) q FROM (SELECT *, list_max(list_transform(x, lambda a: abs(a))) / 7 d FROM ({_halves_sql()}))",
        f"({_DOT} - 8 * list_sum(a.q)) * w.d * a.d",
    ).replace("{codes}", _codes_sql(True)),
}

"""Vector arithmetic of the classifier as native array expressions, summed in double precision and in array order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def doubles(x: Column | str) -> Column:
    return F.transform(_col(x), lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: a.cast("double") * b.cast("double")))


def mean_square(x: Column | str) -> Column:
    return dot(x, x) / F.size(_col(x))


def rms_norm(x: Column | str, weight: Column | str, eps: float = 1e-5) -> Column:
    """x / sqrt(mean(x^2) + eps) * weight."""
    return let(F.sqrt(mean_square(x) + F.lit(eps)), lambda scale: F.zip_with(doubles(x), doubles(weight), lambda a, b: a / scale * b))


def scaled(x: Column | str, s: Column | float) -> Column:
    return F.transform(doubles(x), lambda v: v * s)


def added(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(doubles(x), doubles(y), lambda a, b: a + b)


def add_scaled(d: Column | str, v: Column | str, s: Column | float) -> Column:
    return F.zip_with(doubles(d), doubles(v), lambda a, b: a + b * s)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def swiglu(gate: Column | str, up: Column | str) -> Column:
    return F.zip_with(doubles(gate), doubles(up), lambda g, u: g * sigmoid(g) * u)


def softmax(x: Column | str) -> Column:
    """Shifted by the maximum; uniform where that is not finite; empty stays empty."""
    def of(v: Column) -> Column:
        n = F.size(v)
        finite = lambda top: ~F.isnan(top) & (F.abs(top) < float("inf"))
        shares = lambda top: let(F.transform(v, lambda a: F.exp(a - top)), lambda e: let(total(e), lambda t: F.transform(e, lambda a: a / t)))
        return F.when(n == 0, v).otherwise(let(F.array_max(v), lambda top: F.when(finite(top), shares(top)).otherwise(F.transform(v, lambda a: F.lit(1.0) / n))))

    return let(doubles(x), of)


def best(x: Column) -> Column:
    """The greatest value; NaN never wins, and of nothing it is minus infinity."""
    return F.coalesce(F.array_max(F.filter(x, lambda v: ~F.isnan(v))), F.lit(float("-inf")))


def arg_max(x: Column | str) -> Column:
    """The first position of the greatest value."""
    v = doubles(x)
    return F.array_position(v, F.array_max(v)) - 1


def verdict(yes: Column, no: Column) -> Column:
    """Two-way softmax of the best yes against the best no."""
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


def mscale(factor: float, m: float = 1.0) -> float:
    return 1.0 if factor <= 1 else 0.1 * m * math.log(factor) + 1


def magnitude(factor: float, m: float = 0.0, m_all: float = 0.0, attention: float = 1.0) -> float:
    """What stretched rotary positions scale queries and keys by."""
    return (mscale(factor, m or 1.0) / mscale(factor, m_all) if m_all else mscale(factor)) * attention


def rope_frequencies(dim: int, base: float = 1e6, factor: float = 1.0, context: int = 0, fast: float = 32.0, slow: float = 1.0, blend: float = 0.0) -> list[float]:
    """Angle per position of each pair; with blend, low frequencies are stretched by factor along a linear ramp."""
    pure = [base ** (-2 * i / dim) for i in range(dim // 2)]
    if not (blend and context > 0 and factor > 1):
        return [f / factor for f in pure]
    turns = lambda beta: dim * math.log(context / (beta * 2 * math.pi)) / (2 * math.log(base))
    low, high = (math.inf, dim / 2 - 1) if not fast and not slow else (max(0, math.floor(turns(fast))), min(dim / 2 - 1, math.ceil(turns(slow))))
    out = []
    for i, f in enumerate(pure):
        ramp = min(1.0, max(0.0, (i - low) / max(0.001, high - low)))
        keep = (1 - ramp) * blend
        out.append(f / factor * (1 - keep) + f * keep)
    return out


def frequencies(base: Column, factor: Column, dim: int) -> Column:
    """Angle per position of each pair, by columns."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda i: F.pow(base, -2.0 * i / dim) / factor)


def stretched(base: Column, factor: Column, dim: int, context: int, fast: float = 32.0, slow: float = 1.0) -> Column:
    """The same with low frequencies stretched by factor along a linear ramp of pairs; a factor of 1 stretches nothing."""
    turns = lambda beta: dim * math.log(context / (beta * 2 * math.pi)) / (2 * F.log(base))
    low, high = F.greatest(F.lit(0.0), F.floor(turns(fast)).cast("double")), F.least(F.lit(dim / 2 - 1), F.ceil(turns(slow)).cast("double"))

    def one(i: Column) -> Column:
        ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (i - low) / F.greatest(F.lit(0.001), high - low)))
        pure = F.pow(base, -2.0 * i / dim)
        return F.when(factor > 1, pure / factor * ramp + pure * (1 - ramp)).otherwise(pure)

    return F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), one)


def magnitude_of(factor: Column, m: Column, m_all: Column) -> Column:
    """What stretched rotary positions scale queries and keys by, by columns."""
    scale = lambda by: F.when(factor <= 1, 1.0).otherwise(0.1 * by * F.log(factor) + 1)
    return F.when(m_all != 0, scale(F.when(m == 0, 1.0).otherwise(m)) / scale(m_all)).otherwise(scale(F.lit(1.0)))


def rotate(x: Column | str, position: Column | str, frequencies: list[float], head: int, magnitude: float = 1.0) -> Column:
    """Turn neighbouring pairs of each head; elements beyond the frequencies stay."""
    p = _col(position)
    f = F.array(*[F.lit(float(a)) for a in frequencies])
    n = 2 * len(frequencies)

    def one(v: Column, a: Column, j: Column) -> Column:
        k = j % head
        angle = p * F.element_at(f, F.least(F.floor(k / 2).cast("int"), F.lit(len(frequencies) - 1)) + 1)
        other = F.element_at(v, (j + F.when(k % 2 == 0, 1).otherwise(-1) + 1).cast("int"))
        turned = F.when(k % 2 == 0, a * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + a * F.cos(angle))
        return F.when(k < n, turned * magnitude).otherwise(a)

    return let(doubles(x), lambda v: F.transform(v, lambda a, j: one(v, a, j)))


def temperature(position: Column | str, beta: float, interval: int) -> Column:
    """Scale of queries that grows with the log of the position; 1 without an interval."""
    return 1 + beta * F.log(1 + F.floor(_col(position) / interval)) if interval else F.lit(1.0)


def quantize_block(x: Column | str, even: bool = False) -> Column:
    """A block as scale and codes: d = max|x| / 127; half away from zero, or half to even."""
    near = F.bround if even else F.round
    code = lambda a, d: F.when(d == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), near(a / d).cast("int"))))
    of = lambda v, d: F.struct(d.alias("d"), F.transform(v, lambda a: code(a, d)).alias("q"))
    return let(doubles(x), lambda v: let((F.array_max(F.transform(v, F.abs)) / 127).cast("double"), lambda d: of(v, d)))


def relative_l2(actual: Column | str, expected: Column | str) -> Column:
    """Norm of the difference over the norm expected, or the former where that is 0."""
    diff = F.zip_with(doubles(actual), doubles(expected), lambda a, b: a - b)
    norm, base = F.sqrt(dot(diff, diff)), F.sqrt(dot(expected, expected))
    return F.when(base == 0, norm).otherwise(norm / base)


def worst_error(actual: Column | str, expected: Column | str) -> Column:
    return F.array_max(F.zip_with(doubles(actual), doubles(expected), lambda a, e: F.abs(a - e) / F.greatest(F.lit(1.0), F.abs(e))))


def rounded(x: Column, places: int = 4) -> Column:
    """For comparison: no negative zero."""
    return F.round(x, places) + 0.0


def rounded_all(x: Column, places: int = 4) -> Column:
    return F.transform(x, lambda v: F.round(v, places) + 0.0)

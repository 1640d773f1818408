"""Column functions over numeric arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(fn: Callable[..., Column], *values: Column) -> Column:
    """fn of values that are evaluated once; within a function of each element a plain column is evaluated for each."""
    if not values:
        return fn()
    return F.transform(F.array(values[0]), lambda v: bound(partial(fn, v), *values[1:]))[0]


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """1 for two zero vectors, 0 for one."""
    n, m = dot(a, a), dot(b, b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(dot(a, b) / F.sqrt(n * m))


def normalise(a: Column, mode: int) -> Column:
    """-1: as it is; 0: largest to 32760; 2: unit length; p: the p-norm. A zero vector stays zero."""
    if mode < 0:
        return a
    size = {0: F.array_max(F.transform(a, F.abs)) / 32760.0, 2: F.sqrt(dot(a, a))}.get(mode)
    if size is None:
        size = F.pow(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v), F.lit(float(mode)))), 1.0 / mode)
    return bound(lambda own: F.transform(a, lambda v: F.when(own > 0, v / own).otherwise(0.0)), size)


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(dot(a, a) / F.size(a) + eps)
    return bound(lambda own: F.transform(a, lambda v: v / own), scale)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    def around(mean: Column) -> Column:
        variance = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(a)
        return bound(lambda scale: F.transform(a, lambda v: (v - mean) / scale), F.sqrt(variance + eps))

    return bound(around, total(a) / F.size(a))


def group_norm(a: Column, width: int, eps: float = 1e-6) -> Column:
    """Layer norm of each group of `width` values."""
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda g: F.slice(a, g * width + 1, F.lit(width)))
    return F.flatten(F.transform(groups, lambda g: layer_norm(g, eps)))


def l2_norm(a: Column, eps: float = 1e-12) -> Column:
    size = F.greatest(F.sqrt(dot(a, a)), F.lit(eps))
    return bound(lambda own: F.transform(a, lambda v: v / own), size)


def softmax(a: Column) -> Column:
    weights = bound(lambda most: F.transform(a, lambda v: F.exp(v - most)), F.array_max(a))
    return bound(lambda own: bound(lambda all_own: F.transform(own, lambda w: w / all_own), total(own)), weights)


def cumsum(a: Column) -> Column:
    start = F.array().cast("array<double>")
    return F.aggregate(a, start, lambda s, v: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) + v)))


def argsort(a: Column, descending: bool = False) -> Column:
    """Positions from 0 in the order of their values; equal values keep their order."""
    sign = -1 if descending else 1
    pairs = F.transform(a, lambda v, i: F.struct((v * sign).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def roll(a: Column, by: int) -> Column:
    k = F.pmod(F.lit(by), F.size(a))
    return F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k))


def pad(a: Column, n: int, value: float = 0.0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), n))


def pad_reflect(a: Column, left: int, right: int) -> Column:
    """Mirrors the ends without repeating the edge."""
    return F.concat(F.reverse(F.slice(a, 2, left)), a, F.reverse(F.slice(a, F.size(a) - right, F.lit(right))))


def rotate_half(a: Column) -> Column:
    half = (F.size(a) / 2).cast("int")
    return F.concat(F.transform(F.slice(a, half + 1, half), lambda v: -v), F.slice(a, F.lit(1), half))


def rope(a: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary position embedding: the halves are turned by position / base^(2i/d)."""
    half = F.size(a) / 2
    angle = F.transform(a, lambda v, i: position / F.pow(F.lit(base), F.pmod(i, half) / half))
    return F.transform(F.arrays_zip(a.alias("a"), rotate_half(a).alias("r"), angle.alias("t")), lambda z: z["a"] * F.cos(z["t"]) + z["r"] * F.sin(z["t"]))


def timestep_embedding(t: Column, dim: int, period: float = 10000.0) -> Column:
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: t * F.exp(-F.log(F.lit(period)) * i / half))
    return F.concat(F.transform(angles, F.cos), F.transform(angles, F.sin))


def repeat(a: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def pool(a: Column, width: int, how: str = "avg") -> Column:
    """Average or largest of each full stretch of `width`."""
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1), lambda g: F.slice(a, g * width + 1, F.lit(width)))
    return F.transform(stretches, lambda s: F.array_max(s) if how == "max" else total(s) / width)


def im2col(a: Column, width: int, stride: int = 1) -> Column:
    """All stretches of `width`, `stride` apart."""
    starts = F.sequence(F.lit(1), F.size(a) - width + 1, F.lit(stride))
    return F.transform(starts, lambda s: F.slice(a, s, F.lit(width)))


def conv_1d(a: Column, kernel: list[float], stride: int = 1) -> Column:
    taps = F.array(*map(F.lit, kernel))
    return F.transform(im2col(a, len(kernel), stride), lambda s: dot(s, taps))


def upscale_nearest(a: Column, factor: int) -> Column:
    return F.flatten(F.transform(a, lambda v: F.array_repeat(v, factor)))


def set_range(a: Column, b: Column, offset: int, accumulate: bool = False) -> Column:
    """a with b written, or added, from an offset on."""

    def one(v: Column, i: Column) -> Column:
        other = F.get(b, i - offset)
        return F.when((i >= offset) & other.isNotNull(), v + other if accumulate else other).otherwise(v)

    return F.transform(a, one)


def scan(a: Column, decay: Column) -> Column:
    """The linear recurrence h = decay * h + x."""
    start = F.array().cast("array<double>")
    return F.aggregate(a, start, lambda s, v: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) * decay + v)))


SQRT_2_PI = 0.79788456080286535588
UNARY = {
    "abs": F.abs, "sgn": F.signum, "neg": lambda x: -x, "step": lambda x: F.when(x > 0, 1.0).otherwise(0.0), "tanh": F.tanh,
    "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)), "relu": lambda x: F.greatest(x, F.lit(0.0)), "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(SQRT_2_PI * x * (1 + 0.044715 * x * x))), "gelu_quick": lambda x: x / (1 + F.exp(-1.702 * x)),
    "silu": lambda x: x / (1 + F.exp(-x)), "hardsigmoid": lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 3) / 6)),
    "hardswish": lambda x: x * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 3) / 6)), "exp": F.exp, "expm1": F.expm1,
    "softplus": lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(x))), "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"),
    "round": lambda x: F.round(x), "trunc": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"), "sqr": lambda x: x * x,
    "sqrt": lambda x: F.sqrt(F.abs(x)), "log": lambda x: F.log(F.abs(x) + 1), "sin": F.sin, "cos": F.cos, "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.1 * x),
    "clamp": lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)), "scale": lambda x: x * 2.5 + 1,
    "xielu": lambda x: F.when(x > 0, 0.8 * x * x + 0.5 * x).otherwise((F.expm1(F.least(x, F.lit(-1e-6))) - x) * 0.8 + 0.5 * x),
}


def glu(kind: str, a: Column, b: Column) -> Column:
    """Gated units: an activation of a, times b."""
    if kind == "swiglu_oai":
        x, y = F.least(a, F.lit(7.0)), F.greatest(F.lit(-7.0), F.least(F.lit(7.0), b))
        return x / (1 + F.exp(-1.702 * x)) * (y + 1)
    return UNARY[{"reglu": "relu", "geglu": "gelu", "swiglu": "silu", "geglu_quick": "gelu_quick"}[kind]](a) * b


def solve_lower(matrix: Column, b: Column) -> Column:
    """x of matrix x = b for a lower triangular matrix, an array of rows: forward substitution as a fold."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.arrays_zip(matrix.alias("row"), b.alias("b")), start, lambda x, r: F.concat(x, F.array((r["b"] - dot(F.slice(r["row"], F.lit(1), F.size(x)), x)) / F.element_at(r["row"], F.size(x) + 1))))


def interleaved(sections: list[Column], lengths: list[int]) -> Column:
    """Frequencies of several axes in one array: the first axis, with places i, i + n, i + 2n, ... taken from axis i of n, up to its length."""
    n = len(sections)

    def pick(v: Column, at: Column) -> Column:
        out = v
        for axis in range(1, n):
            out = F.when((at % n == axis) & (at < lengths[axis] * n), F.element_at(sections[axis], at + 1)).otherwise(out)
        return out

    return F.transform(sections[0], pick)

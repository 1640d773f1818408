"""Block quantisation: blocks of 32 values with a scale, as column expressions; and packed bytes, in numpy.

`blocks` keeps scales in double precision. `pack` and `unpack` round scales to 16 bits as the packed
layouts do: a little-endian half-precision scale (and least value), then the codes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 32
KINDS = ("q8_0", "q4_0", "q4_1")


def blocks(rows: DataFrame, a: str, kind: str) -> DataFrame:
    """A row for each block: block, values, d (scale), m (least value) and q (codes). Other columns pass."""
    n = F.ceil(F.size(a) / SIZE).cast("int")
    cut = rows.select(*[c for c in rows.columns if c != a], F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * SIZE + 1, F.lit(SIZE)))).alias("block", "values"))
    low, high = F.array_min("values"), F.array_max("values")
    d, m = {
        "q8_0": (F.greatest(F.abs(low), F.abs(high)) / 127, F.lit(0.0)),
        "q4_0": (F.when(-low > high, low).otherwise(high) / -8, F.lit(0.0)),
        "q4_1": ((high - low) / 15, low),
    }[kind]
    scaled = cut.withColumns({"d": d, "m": m})
    code: dict[str, Callable[[Column], Column]] = {
        "q8_0": lambda x: F.when(F.col("d") == 0, 0).otherwise(F.round(x / F.col("d"))),
        "q4_0": lambda x: F.when(F.col("d") == 0, 8).otherwise(F.least(F.lit(15), F.greatest(F.lit(0), F.floor(x / F.col("d") + 8.5)))),
        "q4_1": lambda x: F.when(F.col("d") == 0, 0).otherwise(F.least(F.lit(15), F.greatest(F.lit(0), F.floor((x - F.col("m")) / F.col("d") + 0.5)))),
    }
    return scaled.withColumn("q", F.transform("values", lambda x: code[kind](x).cast("int")))


def restored(kind: str) -> Column:
    """The values that d, m and q stand for."""
    if kind == "q8_0":
        return F.transform("q", lambda q: q * F.col("d"))
    if kind == "q4_0":
        return F.transform("q", lambda q: (q - 8) * F.col("d"))
    return F.transform("q", lambda q: q * F.col("d") + F.col("m"))


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype("<f2")


def _inverse(d: np.ndarray) -> np.ndarray:
    return np.divide(1.0, d, out=np.zeros_like(d), where=d != 0)


def _codes(x: np.ndarray, zero: float, most: int) -> np.ndarray:
    return np.clip(np.trunc(x + zero), 0, most).astype(np.uint8)


def _signed_extreme(x: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, np.abs(x).argmax(axis=1)[:, None], axis=1)


def _nibbles(q: np.ndarray) -> np.ndarray:
    return q[:, :16] | (q[:, 16:] << 4)


def _from_nibbles(b: np.ndarray) -> np.ndarray:
    return np.concatenate([b & 15, b >> 4], axis=1)


def _fifth(q: np.ndarray) -> np.ndarray:
    return np.packbits(q >> 4, axis=1, bitorder="little")


def _pack_q8_0(x):
    d = np.abs(x).max(axis=1, keepdims=True) / 127
    q = x * _inverse(d)
    return [_half(d), (np.sign(q) * np.floor(np.abs(q) + 0.5)).astype(np.int8)]


def _pack_q4_0(x):
    d = _signed_extreme(x) / -8
    return [_half(d), _nibbles(_codes(x * _inverse(d), 8.5, 15))]


def _pack_q4_1(x):
    m = x.min(axis=1, keepdims=True)
    d = (x.max(axis=1, keepdims=True) - m) / 15
    return [_half(d), _half(m), _nibbles(_codes((x - m) * _inverse(d), 0.5, 15))]


def _pack_q5_0(x):
    d = _signed_extreme(x) / -16
    q = _codes(x * _inverse(d), 16.5, 31)
    return [_half(d), _fifth(q), _nibbles(q & 15)]


def _pack_q5_1(x):
    m = x.min(axis=1, keepdims=True)
    d = (x.max(axis=1, keepdims=True) - m) / 31
    q = _codes((x - m) * _inverse(d), 0.5, 31)
    return [_half(d), _half(m), _fifth(q), _nibbles(q & 15)]


def _pack_bf16(x):
    """Upper half of a single, rounded to even; a NaN stays one."""
    bits = x.astype("<f4").view(np.uint32)
    rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
    return [np.where(np.isnan(x), (bits >> 16) | 64, rounded).astype("<u2")]


def _parts(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    return np.split(data, np.cumsum(widths)[:-1], axis=1)


def _halves(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b).view("<f2").astype(np.float64)


def _unpack_q8_0(b):
    d, q = _parts(b, 2, 32)
    return _halves(d) * np.ascontiguousarray(q).view(np.int8)


def _unpack_q4_0(b):
    d, q = _parts(b, 2, 16)
    return _halves(d) * (_from_nibbles(q).astype(np.float64) - 8)


def _unpack_q4_1(b):
    d, m, q = _parts(b, 2, 2, 16)
    return _halves(d) * _from_nibbles(q) + _halves(m)


def _five(high: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _from_nibbles(q) | (np.unpackbits(high, axis=1, bitorder="little") << 4)


def _unpack_q5_0(b):
    d, high, q = _parts(b, 2, 4, 16)
    return _halves(d) * (_five(high, q).astype(np.float64) - 16)


def _unpack_q5_1(b):
    d, m, high, q = _parts(b, 2, 2, 4, 16)
    return _halves(d) * _five(high, q) + _halves(m)


def _unpack_bf16(b):
    return (np.ascontiguousarray(b).view("<u2").astype(np.uint32) << 16).view(np.float32).astype(np.float64)


#: Format: bytes a block, packing, unpacking. Further formats are entries here.
PACKED = {
    "q8_0": (34, _pack_q8_0, _unpack_q8_0),
    "q4_0": (18, _pack_q4_0, _unpack_q4_0),
    "q4_1": (20, _pack_q4_1, _unpack_q4_1),
    "q5_0": (22, _pack_q5_0, _unpack_q5_0),
    "q5_1": (24, _pack_q5_1, _unpack_q5_1),
    "bf16": (64, _pack_bf16, _unpack_bf16),
}


def packed_bytes(values: np.ndarray, kind: str) -> bytes:
    """Values, a multiple of the block size, as packed blocks."""
    x = np.asarray(values, dtype=np.float64).reshape(-1, SIZE)
    parts = [np.ascontiguousarray(p).view(np.uint8).reshape(len(x), -1) for p in PACKED[kind][1](x)]
    return np.concatenate(parts, axis=1).tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size, _, back = PACKED[kind]
    return back(np.frombuffer(data, dtype=np.uint8).reshape(-1, size)).reshape(-1)


def pack(a: Column, kind: str) -> Column:
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: packed_bytes(v, kind), na_action="ignore")

    return run(a)


def unpack(data: Column, kind: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: unpacked(v, kind), na_action="ignore")

    return run(data)


def packed_size(n: Column, kind: str) -> Column:
    """Bytes of n values."""
    return n / SIZE * PACKED[kind][0]

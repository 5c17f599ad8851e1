"""Scalar functions of the embedded language as columns: strings, bytes, collections, URLs, JSON, hashes, units, waves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def split(s, sep) -> Column:
    """By a literal separator."""
    return F.split(col(s), F.concat(F.lit("\\Q"), col(sep), F.lit("\\E")))


def substring(s, start, length=None) -> Column:
    """Zero-based start; to the end without a length."""
    return F.substring(col(s), col(start) + 1, F.length(col(s)) if length is None else col(length))


def char_at(s, i) -> Column:
    s, i = col(s), col(i)
    return F.when((i >= 0) & (i < F.length(s)), F.substring(s, i + 1, F.lit(1))).otherwise(F.raise_error(F.lit("index out of range")))


def bytes_slice(b, start, length) -> Column:
    return F.substring(col(b).cast("binary"), col(start) + 1, col(length))


def byte_at(b, i) -> Column:
    return F.conv(F.hex(bytes_slice(b, i, 1)), 16, 10).cast("long")


def number_text(x) -> Column:
    """Shortest round-trip text of a number: integers of a double keep ".0", exponents as 1e+20 style are left to the caller."""
    x = col(x)
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def parse_number(s) -> Column:
    """Integers with _ separators and radix prefixes 0x, 0o, 0b; floats; +inf.0, -inf.0, +nan.0; null if none."""
    t = F.regexp_replace(col(s), "_", "")
    sign, body = F.when(t.startswith("-"), -1.0).otherwise(1.0), F.regexp_replace(t, "^[+-]", "")
    out = F.when(t == "+inf.0", float("inf")).when(t == "-inf.0", float("-inf")).when(t == "+nan.0", float("nan"))
    for prefix, radix, digits in (("0x", 16, "0-9a-fA-F"), ("0o", 8, "0-7"), ("0b", 2, "01")):
        out = out.when(body.rlike(f"^{prefix}[{digits}]+$"), sign * F.conv(F.substring(body, F.lit(3), F.length(body)), radix, 10).cast("double"))
    return out.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def url_encode(s) -> Column:
    """Percent encoding with the unreserved set; a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(col(s)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_decode(s) -> Column:
    return F.url_decode(col(s))


def range_(a, b=None) -> Column:
    """a, ..., b - 1, or 0, ..., a - 1; empty if there is none."""
    low, high = (F.lit(0).cast("long"), col(a)) if b is None else (col(a), col(b))
    return F.when(high > low, F.sequence(low.cast("long"), (high - 1).cast("long"))).otherwise(F.array().cast("array<long>"))


def zip_(a, b) -> Column:
    """Pairs, as many as the shorter list has."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return F.arrays_zip(F.slice(col(a), F.lit(1), n).alias("a"), F.slice(col(b), F.lit(1), n).alias("b"))


def set_nth(xs, i, x) -> Column:
    return F.transform(col(xs), lambda v, k: F.when(k == col(i), col(x)).otherwise(v))


def del_nth(xs, i) -> Column:
    return F.filter(col(xs), lambda v, k: k != col(i))


def dict_merge(a, b) -> Column:
    """The second wins on shared keys."""
    return F.map_concat(F.map_filter(col(a), lambda k, v: ~F.map_contains_key(col(b), k)), col(b))


def del_attr(d, key) -> Column:
    return F.map_filter(col(d), lambda k, v: k != col(key))


def sha256(x) -> Column:
    return F.unhex(F.sha2(col(x).cast("binary"), 256))


#: Factors and offsets to the base unit of each dimension.
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "cm": ("length", 0.01, 0.0), "mm": ("length", 0.001, 0.0), "ft": ("length", 0.3048, 0.0), "in": ("length", 0.0254, 0.0), "mi": ("length", 1609.344, 0.0),
    "s": ("time", 1.0, 0.0), "ms": ("time", 0.001, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0), "lb": ("mass", 0.45359237, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 459.67 * 5 / 9), "rad": ("angle", 1.0, 0.0), "deg": ("angle", math.pi / 180, 0.0),
}


def convert(x, a: str, b: str) -> Column:
    """Linear and affine unit conversion."""
    (da, fa, oa), (db, fb, ob) = UNITS[a], UNITS[b]
    if da != db:
        raise ValueError(f"{a} and {b} measure different things")
    return (col(x) * fa + oa - ob) / fb


def piecewise(x, nodes: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear function through (at, value) nodes, constant outside: transfer functions and colour maps."""
    nodes = sorted(nodes)
    x = col(x)
    out = F.when(x <= nodes[0][0], nodes[0][1])
    for (a, u), (b, v) in zip(nodes, nodes[1:]):
        out = out.when(x <= b, u + (x - a) / (b - a) * (v - u) if b > a else F.lit(float(v)))
    return out.otherwise(F.lit(float(nodes[-1][1])))


def colormap(x, low: float, high: float, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> Column:
    """RGB of a value over [low, high]; non-finite values are 128, 128, 128."""
    x = col(x)
    t = (F.greatest(F.lit(low), F.least(F.lit(high), x)) - low) / (high - low)
    rgb = [F.round(piecewise(t, [(a, c[k]) for a, c in stops])).cast("int") for k in range(3)]
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.array(F.lit(128), F.lit(128), F.lit(128))).otherwise(F.array(*rgb))


def bake(nodes: Sequence[tuple[float, float]], n: int, cubed: bool = False) -> list[float]:
    """Table of a piecewise-linear opacity over [0, 1]; cubed if asked."""
    nodes, out = sorted(nodes), []
    for k in range(n):
        x = k / (n - 1)
        v = nodes[0][1] if x <= nodes[0][0] else nodes[-1][1]
        for (a, u), (b, w) in zip(nodes, nodes[1:]):
            if a < x <= b:
                v = u + (x - a) / (b - a) * (w - u)
        out.append(v**3 if cubed else v)
    return out


def to_normalized(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(x) - low) / (high - low))) if high > low else F.lit(0.0)


def wind_profile(speed, height, reference: float = 10.0, power: float = 1 / 7) -> Column:
    return col(speed) * F.pow(F.greatest(col(height), F.lit(0.0)) / reference, F.lit(power))


def jonswap(omega, peak: float, alpha: float = 0.0081, gamma: float = 3.3) -> Column:
    """Spectral density of a sea state at an angular frequency."""
    w = col(omega)
    sigma = F.when(w <= peak, 0.07).otherwise(0.09)
    r = F.exp(-F.pow(w - peak, 2) / (2 * sigma * sigma * peak * peak))
    return alpha * 9.81**2 / F.pow(w, 5) * F.exp(-1.25 * F.pow(peak / w, 4)) * F.pow(F.lit(gamma), r)

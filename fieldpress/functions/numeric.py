"""Numeric expressions with array-library semantics: all are Column in, Column out, within code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPSILON = 1e-20


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def known(x: Column) -> Column:
    """NaN as null: what statistics leave out."""
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite, 0/0 NaN."""
    return F.when(b != 0, a / b).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(float("nan")))


def bitround(x: Column, keep: Column | int, mantissa: int = 52) -> Column:
    """x with `keep` mantissa bits, halves to even; the full mantissa, zero and what isn't finite stay as they are."""
    keep = keep if isinstance(keep, Column) else F.lit(keep)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - keep)
    return F.when((keep >= mantissa) | (x == 0) | ~finite(x), x).otherwise(F.rint(x / unit) * unit)


def quantize_scale(digits: int) -> float:
    return 2.0 ** math.ceil(math.log2(10.0**digits))


def quantize(x: Column, digits: Column | int) -> Column:
    """x to `digits` decimals, by a power-of-two scale."""
    scale = F.lit(quantize_scale(digits)) if not isinstance(digits, Column) else F.pow(F.lit(2.0), F.ceil(F.log2(F.pow(F.lit(10.0), digits))))
    return F.rint(x * scale) / scale


def asinh_encode(x: Column, width: Column) -> Column:
    """width * asinh(x / width); a width of 0 leaves x."""
    return F.when(width == 0, x).otherwise(width * F.asinh(x / width))


def asinh_decode(c: Column, width: Column) -> Column:
    return F.when(width == 0, c).otherwise(width * F.sinh(c / width))


def scale_encode(x: Column, offset: Column, scale: Column) -> Column:
    return (x - offset) / scale


def scale_decode(c: Column, offset: Column, scale: Column) -> Column:
    return c * scale + offset


def clip(x: Column, floor: float | None = None, cap: float | None = None) -> Column:
    x = x if floor is None else F.greatest(x, F.lit(floor))
    return x if cap is None else F.least(x, F.lit(cap))


def safe_scale(x: Column, least: float = 1e-12) -> Column:
    return F.when(finite(x) & (F.abs(x) >= least), x)


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (F.abs(a) + F.lit(EPSILON))


def jittered(x: Column, seed: int, size: float = 1e-5) -> Column:
    return x + F.randn(seed) * size


def decimal_comma(x: Column) -> Column:
    """A number written with a decimal comma; blank is null."""
    return F.when(F.trim(x) != "", F.replace(F.trim(x), F.lit(","), F.lit("."))).cast("double")


def scientific(x: Column, digits: int = 3) -> Column:
    """A number as text with an exponent, like 1.250e-03."""
    return F.format_string(f"%.{digits}e", x.cast("double"))


#: Names of sizes by powers of 1024.
UNITS = ("Bytes", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def binary_size(n: Column) -> Column:
    """A number of bytes as text in the largest unit that it fills, like 1.5 KiB."""
    n = n.cast("double")
    out = F.when(n < 1024, F.format_string(f"%.0f {UNITS[0]}", n))
    for k, unit in enumerate(UNITS[1:], 1):
        out = out.when((n < 1024.0 ** (k + 1)) | F.lit(unit == UNITS[-1]), F.format_string(f"%.1f {unit}", n / 1024.0**k))
    return out

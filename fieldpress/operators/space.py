"""The search space: compressors, filters and serializers with their indices, and configurations as a DataFrame.

Indices are what users pass back to `compress`, so enumeration order matters. A codec that can't run here
would be enumerated with `available = False`: its index stays valid, and sweeps leave it out.
"""

from __future__ import annotations

import itertools
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameter grids of the codec families.
BLOSC_NAMES = ("blosclz", "lz4", "lz4hc", "zlib", "zstd")
BLOSC_LEVELS, BLOSC_SHUFFLES = (1, 6, 9), (-1, 0, 1, 2)
LZ4_ACCELERATIONS = (1, 10, 100)
ZSTD_LEVELS = (0, 1, 9, 22)
DEFLATE_LEVELS = (1, 6, 9)
PCODEC_LEVELS, PCODEC_ORDERS = (0, 4, 8, 12), (0, 3, 7)
EBCC_TOLERANCES = (1e-2, 1e-3, 1e-6, 1e-9)
EBCC_BASE_RATIO, EBCC_SIZES = 2, (32, 2047)
KEEPBITS_STEP, DIGITS_STEP = 9, 4
MANTISSA = {"float64": 52, "float32": 23}
DIGITS = {"float64": 15, "float32": 7}
INTEGERS = ("int8", "int16", "int32", "int64")
SCALE_LEAST = 1e-12


@dataclass(frozen=True)
class Codec:
    """One member of a space. `params` are name-value pairs in order."""

    family: str
    params: tuple[tuple[str, object], ...] = ()
    available: bool = True

    @property
    def name(self) -> str:
        return f"{self.family}({', '.join(f'{k}={v}' for k, v in self.params)})"

    def get(self, key: str):
        return dict(self.params)[key]


@dataclass(frozen=True)
class Flags:
    """What may be searched; classes are matched without regard to case."""

    lossy: bool = True
    wasm: bool = True
    ebcc: bool = True
    compressor: str = "all"
    filter: str = "all"
    serializer: str = "all"


@dataclass(frozen=True)
class FieldInfo:
    """What the spaces need of a field: its type, the statistics of scale filters, and its shape for EBCC."""

    dtype: str
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    linear_width: float | None = None
    shape: tuple[int, ...] = field(default=())


def inclusive_range(start, end, step) -> list:
    """start, start + step, ... and always `end` last; `step` may be negative."""
    if step == 0:
        raise ValueError("step must not be 0")
    ahead = (lambda x: x < end) if step > 0 else (lambda x: x > end)
    return [*itertools.takewhile(ahead, itertools.count(start, step)), end] if ahead(start) or start == end else [end]


def keepbits(dtype: str, step: int = KEEPBITS_STEP) -> list[int]:
    if dtype not in MANTISSA:
        raise TypeError(f"bit rounding is for float32 and float64, not {dtype}")
    return inclusive_range(1, MANTISSA[dtype], step)


def digits(dtype: str, step: int = DIGITS_STEP) -> list[int]:
    if dtype not in DIGITS:
        raise TypeError(f"decimal quantisation is for float32 and float64, not {dtype}")
    return inclusive_range(1, DIGITS[dtype], step)


def fixed_accuracy(k: int) -> float:
    return 2.0 ** -(1 << k)


def fixed_precision(k: int) -> int:
    return 1 << (k + 3)


fixed_rate = fixed_precision


def compute_chunks(shape, low_h=0, high_h=None, low_w=0, high_w=None):
    """(chunk height, chunk width, chunks down, chunks across): the first power of a small factor that divides each side into the allowed range; None if none does.

    The default upper bound of both sides is the height.
    """
    h, w = shape[:2]
    high_h, high_w = high_h or h, high_w or h
    powers = [(n * (m + 1), p) for n in (2, 3, 5) for m in range(10) for p in range(7, -1, -1)]
    fits = lambda side, parts, low, high: side % parts == 0 and low <= side / parts <= high
    down = next((d**p for d, p in powers if fits(h, d**p, low_h, high_h)), None)
    across = next((d ** (p - 1) for d, p in powers if p and fits(w, d ** (p - 1), low_w, high_w)), None)
    return None if down is None or across is None else (h / down, w / across, down, across)


def _pick(families: dict[str, list], chosen: str) -> list:
    """The members of a class, or of all; `none` is one empty member; a class that is unknown or off means all."""
    by_name = {k.lower(): v for k, v in families.items()}
    want = chosen.lower()
    if want == "none":
        return [None]
    if want != "all" and want not in by_name:
        warnings.warn(f"class {chosen} is unknown or disabled here: all of {list(families)} are used", stacklevel=3)
    return by_name[want] if want in by_name else [c for v in families.values() for c in v]


def compressor_space(flags: Flags = Flags()) -> list[tuple[int, Codec | None]]:  # noqa: B008
    levels = lambda family, key, values: [Codec(family, ((key, v),)) for v in values]
    blosc = [Codec("Blosc", (("cname", c), ("clevel", n), ("shuffle", s))) for c in BLOSC_NAMES for n in BLOSC_LEVELS for s in BLOSC_SHUFFLES]
    families = {
        "Blosc": blosc, "LZ4": levels("LZ4", "acceleration", LZ4_ACCELERATIONS), "Zstd": levels("Zstd", "level", ZSTD_LEVELS), "Zlib": levels("Zlib", "level", DEFLATE_LEVELS),
        "GZip": levels("GZip", "level", DEFLATE_LEVELS), "BZ2": levels("BZ2", "level", DEFLATE_LEVELS), "LZMA": levels("LZMA", "preset", DEFLATE_LEVELS),
    }
    return list(enumerate(_pick(families, flags.compressor)))


def safe_scale(x: float | None) -> float | None:
    """A scale that can be divided by, or None."""
    return x if x is not None and abs(x) < float("inf") and abs(x) >= SCALE_LEAST else None


def filter_space(info: FieldInfo, flags: Flags = Flags()) -> list[tuple[int, Codec | None]]:  # noqa: B008
    if info.dtype not in MANTISSA and info.dtype not in INTEGERS:
        raise TypeError(f"no filters for {info.dtype}")
    families: dict[str, list] = {"Delta": [Codec("Delta")]}
    if info.dtype in MANTISSA:
        if flags.lossy:
            families["BitRound"] = [Codec("BitRound", (("keepbits", k),)) for k in keepbits(info.dtype)]
            families["Quantize"] = [Codec("Quantize", (("digits", k),)) for k in digits(info.dtype)]
            if flags.wasm:
                families["Asinh"] = [Codec("Asinh", (("linear_width", info.linear_width),))]
        if flags.wasm:
            span = None if info.high is None or info.low is None else info.high - info.low
            pairs = ((info.mean, safe_scale(info.std)), (info.low, safe_scale(span)))
            families["FixedOffsetScale"] = [Codec("FixedOffsetScale", (("offset", o), ("scale", s))) for o, s in pairs if o is not None and abs(o) < float("inf") and s is not None]
    return list(enumerate(_pick(families, flags.filter)))


def serializer_space(info: FieldInfo, flags: Flags = Flags()) -> list[tuple[int, Codec | None]]:  # noqa: B008
    made = lambda family, **kw: Codec(family, tuple(kw.items()))
    modes = [("rate", fixed_rate)] if info.dtype in INTEGERS else [("tolerance", fixed_accuracy), ("precision", fixed_precision), ("rate", fixed_rate)]
    zfp = lambda family: [made(family, **{key: value(k)}) for key, value in modes for k in range(3)]
    families: dict[str, list] = {"PCodec": [made("PCodec", level=n, delta_encoding_order=o) for n in PCODEC_LEVELS for o in PCODEC_ORDERS]}
    if flags.lossy:
        families["ZFPY"] = zfp("ZFPY")
        if flags.ebcc:
            families["EBCCZarrFilter"] = [made("EBCCZarrFilter", base_cr=EBCC_BASE_RATIO, atol=t) for t in EBCC_TOLERANCES]
        if flags.wasm:
            families["Zfp"] = zfp("Zfp")
    return list(enumerate(_pick(families, flags.serializer)))


#: Serializers that take the field as it is: filters before them are dropped.
WHOLE = ("EBCCZarrFilter", "Zfp")
PART = "idx int, family string, name string, params map<string,string>, available boolean"


def _frame(spark: SparkSession, space: list[tuple[int, Codec | None]], prefix: str) -> DataFrame:
    rows = [(-1, "None", "None", {}, True) if c is None else (i, c.family, c.name, {k: str(v) for k, v in c.params}, c.available) for i, c in space]
    return spark.createDataFrame(rows, PART).select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("idx", "family", "name", "params", "available")])


def config_frame(spark: SparkSession, info: FieldInfo, flags: Flags = Flags()) -> DataFrame:  # noqa: B008
    """All configurations, serializers innermost: `ordinal`, index, class, name and parameters of each part, and the filter in effect."""
    spaces = compressor_space(flags), filter_space(info, flags), serializer_space(info, flags)
    sizes = [len(s) for s in spaces]
    comp, filt, ser = (_frame(spark, s, p) for s, p in zip(spaces, ("comp", "filt", "ser"), strict=True))
    at = lambda p: F.greatest(F.col(f"{p}_idx"), F.lit(0)).cast("long")
    both = comp.crossJoin(F.broadcast(filt)).crossJoin(F.broadcast(ser))  # tables of at most some dozen rows
    dropped = F.col("ser_family").isin(*WHOLE)
    return both.select(
        ((at("comp") * sizes[1] + at("filt")) * sizes[2] + at("ser")).alias("ordinal"), "*",
        F.when(dropped, -1).otherwise(F.col("filt_idx")).alias("eff_filt_idx"), F.when(dropped, "None").otherwise(F.col("filt_name")).alias("eff_filt_name"),
        (F.col("comp_available") & F.col("filt_available") & F.col("ser_available")).alias("available"),
    )


def pair_text(idx: Column, name: Column) -> Column:
    """An index and a codec's name as one text, as tables of configurations list them: (3, Zlib(level=9))."""
    return F.concat(F.lit("("), idx.cast("string"), F.lit(", "), name, F.lit(")"))


def pair_of(text: Column) -> Column:
    """The index and name of such a text; only the first comma parts them."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    parts = F.split(inner, ", ", 2)
    return F.struct(parts[0].cast("int").alias("idx"), parts[1].alias("name"))


def effective(config: DataFrame) -> DataFrame:
    """Distinct pipelines among configurations, with the ordinals that each stands for: evaluated once."""
    return config.groupBy("comp_idx", "eff_filt_idx", "ser_idx").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("n_configs"))


def check_index(idx: int, space: list, what: str) -> Codec | None:
    """The codec of an index; -1 is none."""
    if not -1 <= idx < len(space):
        raise IndexError(f"{what} index {idx} is not in -1..{len(space) - 1}")
    return None if idx == -1 else space[idx][1]


def get_indexes(config: DataFrame, comp: str, filt: str, ser: str) -> DataFrame:
    """Indices of codecs by name; "None" and unknown names are -1, any EBCC name falls back to the first EBCC codec."""
    out = []
    for prefix, name in (("comp", comp), ("filt", filt), ("ser", ser)):
        exact = F.max(F.when(F.col(f"{prefix}_name") == name, F.col(f"{prefix}_idx")))
        near = F.min(F.when(F.col(f"{prefix}_name").contains("EBCC") & F.lit("EBCC" in name), F.col(f"{prefix}_idx")))
        out.append(F.coalesce(exact, near, F.lit(-1)).alias(f"{prefix}_idx"))
    return config.agg(*out)

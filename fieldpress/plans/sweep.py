"""The sweep: evaluate configurations of a field, keep those within its limit, rank them, encode with one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpress.operators import codecs, metrics
from fieldpress.operators.arrays import percent_slice
from fieldpress.operators.filters import field_info
from fieldpress.operators.space import WHOLE, Codec, FieldInfo, Flags, check_index, compressor_space, config_frame, filter_space, serializer_space

ERRORS = [c.split()[0] for c in codecs.ERRORS]
SCORED = ("ordinal", "ratio", "rel_l1", "rel_l2", "rel_linf", "euclid", "compressor", "filter", "serializer", "comp_idx", "filt_idx", "ser_idx")


def runnable(info: FieldInfo, flags: Flags) -> list[tuple[int, Codec | None, codecs.Front]]:
    """(ordinal, compressor, (filter, serializer)) of the distinct pipelines that can run here.

    Serializers that take the field as it is drop the filter, so they run once for all filters. The plain byte
    serializer is not enumerated; it runs when the serializer class is `none`.
    """
    comps, filts, sers = compressor_space(flags), filter_space(info, flags), serializer_space(info, flags)
    out = []
    for ci, (_, c) in enumerate(comps):
        for fi, (_, f) in enumerate(filts):
            for si, (_, s) in enumerate(sers):
                whole = s is not None and s.family in WHOLE
                if (s is None or s.available) and (not whole or fi == 0):
                    out.append(((ci * len(filts) + fi) * len(sers) + si, c, (None if whole else f, s)))
    return out


def _sums(*names: str) -> list[Column]:
    return [(F.max if c.startswith("max") else F.sum)(c).alias(c) for c in names]


def within(chunks: DataFrame, dtype: str, configs: list[tuple[int, Codec | None, codecs.Front]], limit: float | None) -> list[tuple[int, Codec | None, codecs.Front]]:
    """The configurations whose front's errors are within the limit: one pass over the field that runs no compressor."""
    fronts = list(dict.fromkeys(f for _, _, f in configs))
    if not limit or not fronts:
        return configs
    scored = codecs.errors(chunks, dtype, fronts).groupBy("front").agg(*_sums(*ERRORS)).select("front", *metrics.norms())
    good = {fronts[r.front] for r in metrics.threshold_gate(scored, limit).select("front").collect()}  # a row per front
    return [c for c in configs if c[2] in good]


def evaluate_combos(cells: DataFrame, dtype: str, limit: float | None = None, flags: Flags = Flags(serializer="none"), sizes: dict[str, int] | None = None, percent: float | None = None, chunk_cells: int = codecs.CHUNK_CELLS) -> DataFrame:  # noqa: B008
    """Scored configurations of one field, cells (idx, value),, within the limit."""
    if sizes:
        cells = percent_slice(cells, sizes, percent)
    info = field_info(cells, dtype)
    configs = runnable(info, flags)
    spark = cells.sparkSession
    chunks = codecs.chunked(cells, dtype, cells=chunk_cells)
    configs = within(chunks, dtype, configs, limit)
    n = (cells.agg(F.max("idx")).first()[0] or 0) + 1
    partial = codecs.sweep(chunks, dtype, configs, codecs.split_for(spark, -(-n // chunk_cells)))
    scored = partial.groupBy("ordinal").agg(*_sums("raw_bytes", "enc_bytes"), *_sums(*ERRORS)).select("ordinal", (F.col("raw_bytes") / F.col("enc_bytes")).alias("ratio"), *metrics.norms())
    names = config_frame(spark, info, flags).select("ordinal", F.col("comp_name").alias("compressor"), F.col("eff_filt_name").alias("filter"), F.col("ser_name").alias("serializer"), "comp_idx", F.col("eff_filt_idx").alias("filt_idx"), "ser_idx")
    return metrics.threshold_gate(scored, limit).join(names, "ordinal").select(*SCORED)


def chosen(cells: DataFrame, dtype: str, comp_idx: int, filt_idx: int, ser_idx: int = -1, flags: Flags = Flags()) -> tuple[Codec | None, codecs.Front]:  # noqa: B008
    """The compressor, and the filter and serializer in effect, of these indices; -1 is no codec."""
    info = field_info(cells, dtype)
    comp = check_index(comp_idx, compressor_space(flags), "compressor")
    filt = check_index(filt_idx, filter_space(info, flags), "filter")
    ser = check_index(ser_idx, serializer_space(info, flags), "serializer")
    return comp, (None if ser is not None and ser.family in WHOLE else filt, ser)


def compress(cells: DataFrame, dtype: str, comp_idx: int, filt_idx: int, ser_idx: int = -1, flags: Flags = Flags(), chunk_cells: int = codecs.CHUNK_CELLS) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(encoded chunks, ratio and errors) of one configuration by its indices; -1 is no codec."""
    comp, front = chosen(cells, dtype, comp_idx, filt_idx, ser_idx, flags)
    chunks = codecs.chunked(cells, dtype, cells=chunk_cells)
    return encoded(chunks, dtype, comp, front), scores(chunks, dtype, comp, front)


def scores(chunks: DataFrame, dtype: str, comp: Codec | None, front: codecs.Front) -> DataFrame:
    partial = codecs.sweep(chunks, dtype, [(0, comp, front)])
    both = partial.agg(*_sums(*(c for c in partial.columns if c != "ordinal")))
    return both.select((F.col("raw_bytes") / F.col("enc_bytes")).alias("ratio"), *metrics.norms())


def encoded(chunks: DataFrame, dtype: str, comp: Codec | None, front: codecs.Front) -> DataFrame:
    """The chunks with their payload encoded, and `raw_bytes`, its size before compression."""
    kind = np.dtype(codecs.NUMPY[dtype])
    names = chunks.columns

    def run(batches):
        for b in batches:
            at = names.index("payload")
            raw = [codecs.front_encode(np.frombuffer(r.as_py(), kind), front) for r in b.column(at)]
            out = [codecs.compress(r, comp, kind.itemsize) for r in raw]
            yield pa.record_batch([*(pa.array(out, pa.binary()) if i == at else b.column(i) for i in range(len(names))), pa.array([len(r) for r in raw], pa.int64())], [*names, "raw_bytes"])

    return chunks.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in chunks.schema)}, raw_bytes long")


def decoded(chunks: DataFrame, dtype: str, comp: Codec | None, front: codecs.Front) -> DataFrame:
    """The chunks of `encoded` with their payload decoded again."""
    kind = np.dtype(codecs.NUMPY[dtype])
    names = [c for c in chunks.columns if c != "raw_bytes"]

    def run(batches):
        for b in batches:
            own = dict(zip(b.schema.names, b.columns, strict=True))
            out = [codecs.front_decode(codecs.decompress(r, comp, n, kind.itemsize), front, kind).tobytes() for r, n in zip(own["payload"].to_pylist(), own["raw_bytes"].to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(out, pa.binary()) if c == "payload" else own[c] for c in names], names)

    return chunks.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema if f.name in names))


def cells_of(chunks: DataFrame, dtype: str, cells: int = codecs.CHUNK_CELLS) -> DataFrame:
    """(idx, value) of decoded chunks."""
    kind = np.dtype(codecs.NUMPY[dtype])

    def run(batches):
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, kind)
                yield pa.record_batch([pa.array(chunk * cells + np.arange(len(x))), pa.array(x)], ["idx", "value"])

    sql = {"float64": "double", "float32": "float", "int64": "long", "int32": "int", "int16": "short", "int8": "byte"}[dtype]
    return chunks.select("chunk", "payload").mapInArrow(run, f"idx long, value {sql}")


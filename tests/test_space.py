import warnings

import pytest

from fieldpress.operators import arrays, metrics, space
from fieldpress.operators.space import FieldInfo, Flags

F64 = FieldInfo("float64", 1.0, 2.0, 0.0, 4.0, 0.5)
F32 = FieldInfo("float32", 1.0, 2.0, 0.0, 4.0, 0.5)
INT = FieldInfo("int32")


def test_counts():
    assert len(space.compressor_space()) == 79
    assert [len(space.filter_space(i)) for i in (F64, F32, INT)] == [16, 11, 1]
    assert [len(space.serializer_space(i)) for i in (F64, INT)] == [34, 22]
    assert len(space.serializer_space(F64, Flags(lossy=False))) == 12


def test_sample_indices():
    flags = Flags(lossy=False, wasm=False, ebcc=False, compressor="Zlib", serializer="PCodec")
    assert space.compressor_space(flags)[2][1].name == "Zlib(level=9)"
    assert space.filter_space(F64, flags)[0][1].name == "Delta()"
    assert space.serializer_space(F64, flags)[9][1].name == "PCodec(level=12, delta_encoding_order=0)"


@pytest.mark.parametrize(("shape", "chunks"), [((721, 1440), (721, 45, 1, 32)), ((361, 720), (361, 45, 1, 16)), ((180, 360), (45, 45, 4, 8)), ((1801, 3600), (1801, 225, 1, 16)), ((4096, 8192), (32, 128, 128, 64)), ((64, 64), (32, 32, 2, 2)), ((1000, 500), (125, 125, 8, 4)), ((137, 721), (137, 721, 1, 1)), ((20, 100), None), ((31, 31), None)])
def test_chunks(shape, chunks):
    assert space.compute_chunks(shape, 32, 2047, 32, 2047) == chunks


def test_ranges():
    assert space.keepbits("float64") == [1, 10, 19, 28, 37, 46, 52] and space.keepbits("float32") == [1, 10, 19, 23]
    assert space.digits("float64") == [1, 5, 9, 13, 15] and space.digits("float32") == [1, 5, 7]
    assert space.inclusive_range(5, 1, -2) == [5, 3, 1] and space.inclusive_range(2, 2, 1) == [2]
    with pytest.raises(ValueError):
        space.inclusive_range(1, 2, 0)
    with pytest.raises(TypeError):
        space.keepbits("uint8")
    assert [space.fixed_accuracy(k) for k in range(3)] == [0.5, 0.25, 0.0625] and [space.fixed_rate(k) for k in range(3)] == [8, 16, 32]


def test_classes_and_constant_fields():
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert len(space.serializer_space(F64, Flags(serializer="Sperr"))) == 34 and w
    assert space.compressor_space(Flags(compressor="none")) == [(0, None)]
    assert len(space.compressor_space(Flags(compressor="ZLIB"))) == 3
    assert len(space.filter_space(FieldInfo("float64", 5.0, 0.0, 5.0, 5.0, 5.0))) == 14
    with pytest.raises(TypeError):
        space.filter_space(FieldInfo("uint8"))
    with pytest.raises(IndexError):
        space.check_index(79, space.compressor_space(), "compressor")
    assert space.check_index(-1, space.compressor_space(), "compressor") is None


def test_rules():
    assert [metrics.cluster_count(n) for n in (36, 7162, 7163, 29546, 42976)] == [1, 1, 2, 5, 6]
    assert arrays.kept(5, 10) * arrays.kept(100, 10) == 10
    assert arrays.is_lat_lon(["lat", "lon"]) and not arrays.is_lat_lon(["lon", "lat"])
    with pytest.raises(ValueError):
        arrays.validate_percentage(0.5)
    with pytest.raises(ValueError):
        arrays.guard([1 << 16, 1 << 16], "float64")
    with pytest.raises(ValueError):
        metrics.error_column("L3")

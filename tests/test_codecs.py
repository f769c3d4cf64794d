"""MVT and PMTiles bytes."""

import json
import math

import numpy as np
import pytest

from quadmill.operators import curves, geom, mvt
from quadmill.operators import pmtiles as pm
from quadmill.operators.geom import LINE, MULTILINE, MULTIPOINT, POINT, POLYGON, Geometry

BOX = (0.0, 0.0, 100.0, 100.0)


def test_varints():
    assert [mvt.varint(n).hex() for n in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**34]
    assert mvt.varints(np.array(numbers)) == b"".join(map(mvt.varint, numbers))
    for bad in (b"", b"\x80", b"\x80" * 11):
        with pytest.raises(ValueError):
            mvt.read_varint(bad, 0)
    assert mvt.zigzag(np.array([0, -1, 1, -2, 2])).tolist() == [0, 1, 2, 3, 4]


def test_commands():
    point, kind = mvt.commands(Geometry(POINT, np.array([25.0, 75.0])), BOX, 100)
    assert point.tolist() == [9, 50, 50] and kind == mvt.POINTS
    line, _ = mvt.commands(Geometry(LINE, np.array([[0, 100], [10, 100], [10, 90]], float)), BOX, 100)
    assert line.tolist() == [9, 0, 0, 2 << 3 | 2, 20, 0, 0, 20]
    many, _ = mvt.commands(Geometry(MULTIPOINT, np.array([[1, 99], [3, 99]], float)), BOX, 100)
    assert many.tolist() == [17, 2, 2, 4, 0]
    assert not len(mvt.commands(Geometry(LINE, np.zeros((1, 2))), BOX)[0])
    assert mvt.commands(Geometry(geom.COLLECTION, []), BOX)[1] == mvt.UNKNOWN


def test_rounding_is_half_away_from_zero():
    p = mvt.pixels(np.array([[0.5, 127.5], [2.5, 125.5], [-0.5, 128.5]]), (0.0, 0.0, 128.0, 128.0), 128)
    assert p.tolist() == [[1, 1], [3, 3], [-1, -1]]


def test_tile_roundtrip_with_properties():
    ring = np.array([[10, 10], [10, 30], [30, 30], [30, 10], [10, 10]], float)
    layer = mvt.Layer("shapes", 100)
    values = {"name": "ä", "n": -5, "d": 1.5, "yes": True, "one": 1}
    tags = [(k, mvt.value_message(v)) for k, v in values.items()]
    for i, g in enumerate([Geometry(POLYGON, [ring]), Geometry(MULTILINE, [ring[:2], ring[2:4]])]):
        numbers, kind = mvt.commands(g, BOX, 100)
        layer.add(i, kind, mvt.varints(numbers), tags)
    layer.add(9, mvt.UNKNOWN, b"")
    got = mvt.decode(layer.tile())[0]
    assert (got["name"], got["extent"], got["version"], len(got["features"])) == ("shapes", 100, 2, 2)
    f = got["features"][0]
    assert f["properties"] == values and f["id"] == 0 and type(f["properties"]["yes"]) is bool
    assert set(f["paths"][0]) == {(10, 90), (30, 90), (30, 70), (10, 70)} and f["paths"][0][0] == f["paths"][0][-1]
    x, y = np.array(f["paths"][0], float).T
    assert (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() < 0  # counter-clockwise on the ground, with y downward here
    assert got["features"][1]["paths"] == [[(10, 90), (10, 70)], [(30, 70), (30, 90)]]
    assert mvt.decode(b"\x1a" + b"\x00")[0]["features"] == []


def test_tile_ids_and_back():
    assert [int(curves.hilbert_keys([x], [y], 1)[0]) + 1 for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]
    for z in range(6):
        ids = set()
        for x in range(1 << z):
            for y in range(1 << z):
                t = ((1 << 2 * z) - 1) // 3 + int(curves.hilbert_keys([x], [y], z)[0])
                assert pm.zxy(t) == (z, x, y)
                ids.add(t)
        assert len(ids) == 1 << 2 * z


def test_tile_boxes():
    box = curves.tile_box(0, 0, 0)
    assert box[0] == -180 and box[2] == 180 and 85 < box[3] < 85.06
    assert curves.tile_of(0, 0, 1) == (1, 1) and curves.tile_of(180, -90, 3) == (7, 7) and curves.tile_of(-180, 90, 3) == (0, 0)


def test_directory_roundtrip():
    entries = [pm.Entry(0, 0, 10, 1), pm.Entry(5, 10, 20, 3), pm.Entry(9, 0, 10, 1), pm.Entry(300, 30, 5, 1)]
    raw = pm.write_directory(entries)
    assert pm.read_directory(raw) == entries
    assert raw[0] == 4 and list(raw[-4:]) == [1, 0, 1, 31]


def test_header():
    h = pm.Header(root_length=7, bounds=(-1.5, -2.0, 3.0, 4.0), min_zoom=1, max_zoom=6, tile_codec=pm.Codec.ZSTD)
    raw = h.pack()
    assert len(raw) == 127 and raw[:7] == b"PMTiles" and raw[7] == 3
    assert pm.Header.unpack(raw) == h
    with pytest.raises(ValueError):
        pm.Header.unpack(b"x" * 127)


@pytest.mark.parametrize("codec", [pm.Codec.NONE, pm.Codec.GZIP, pm.Codec.ZSTD])
def test_codecs(codec):
    raw = b"tile " * 100
    assert pm.decompress(pm.compress(raw, codec), codec) == raw


def test_codec_names():
    assert pm.Codec.parse("GZip") == pm.Codec.GZIP
    with pytest.raises(ValueError):
        pm.Codec.parse("lzma")
    with pytest.raises(ValueError):
        pm.compress(b"", pm.Codec.UNKNOWN)


@pytest.mark.parametrize("n", [0, 3, 4000, 20000])
def test_archives_with_and_without_leaves(tmp_path, n):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2000, n).tolist()
    data = tmp_path / "data"
    data.write_bytes(b"".join(bytes([i % 251]) * k for i, k in enumerate(lengths)))
    at, entries = 0, []
    for i, k in enumerate(lengths):
        entries.append(pm.Entry(i * 3 + int(rng.integers(0, 2)), at, k, 1))
        at += k
    path = str(tmp_path / "a.pmtiles")
    info = pm.ArchiveInfo('a "layer"', {"f": "String"}, None, pm.Codec.NONE, n, 0, 9, n, n)
    pm.assemble(path, iter(entries), [str(data)], info)
    a = pm.Archive(path)
    assert a.header.root_length <= pm.ROOT_BYTES and (a.header.leaves_length > 0) == (n >= 4000)
    assert list(a.entries()) == entries
    for e in entries[:: max(1, n // 20)]:
        assert a.data(e) == bytes([entries.index(e) % 251]) * e.length
    assert a.metadata()["vector_layers"][0]["id"] == 'a "layer"' and ("tilestats" in a.metadata()) == (n > 0)
    assert math.isclose(a.header.bounds[0], -180) and sorted(p.name for p in tmp_path.iterdir()) == ["a.pmtiles", "data"]
    assert json.loads(info.to_json())["layer"] == 'a "layer"'

"""Geometry kernels against hand values and invariants."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadmill.operators import curves, geom, kernels
from quadmill.operators.geom import COLLECTION, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry

UNIT = (0.0, 0.0, 1.0, 1.0)
coord = st.floats(-3, 3).map(lambda v: round(v, 3))
path = st.lists(st.tuples(coord, coord), min_size=2, max_size=12).map(lambda p: np.array(p, float))


def square(x, y, s):
    return np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)


SHAPES = [
    Geometry(POINT, np.array([1.5, -2.0])),
    Geometry(LINE, np.array([[0, 0], [1, 1], [2, 0]], float)),
    Geometry(POLYGON, [square(0, 0, 4), square(1, 1, 1)]),
    Geometry(MULTIPOINT, np.array([[0, 0], [1, 2]], float)),
    Geometry(MULTILINE, [np.array([[0, 0], [1, 1]], float), np.array([[5, 5], [6, 6]], float)]),
    Geometry(MULTIPOLYGON, [[square(0, 0, 1)], [square(3, 3, 2), square(3.5, 3.5, 0.5)]]),
    Geometry(COLLECTION, [Geometry(POINT, np.array([1.0, 1.0])), Geometry(LINE, np.array([[0, 0], [1, 1]], float))]),
]


@pytest.mark.parametrize("g", SHAPES, ids=[geom.NAMES[g.kind] for g in SHAPES])
def test_wkb_roundtrip(g):
    raw = geom.to_wkb(g)
    assert geom.to_wkb(geom.from_wkb(raw)) == raw


def test_wkb_big_endian_and_z():
    raw = struct.pack(">BIddd", 0, 1001, 1.0, 2.0, 3.0)
    assert geom.from_wkb(raw).data.tolist() == [1.0, 2.0]
    assert geom.from_wkb(struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 1.0, 2.0)).data.tolist() == [1.0, 2.0]
    for bad in (b"", b"\x01\x01", struct.pack("<BI", 1, 99), geom.to_wkb(SHAPES[2])[:-4]):
        with pytest.raises(geom.InvalidGeometry):
            geom.from_wkb(bad)


def test_measures():
    assert geom.polygon_area([square(0, 0, 4), square(1, 1, 1)]) == 15
    assert geom.centroid(Geometry(POLYGON, [square(0, 0, 2)])) == (1, 1)
    assert geom.centroid(SHAPES[1]) == (1, 0.5)
    assert geom.centroid(Geometry(LINE, np.zeros((0, 2)))) is None and geom.bbox(Geometry(MULTIPOINT, np.zeros((0, 2)))) is None
    assert geom.bbox(SHAPES[5]) == (0, 0, 5, 5)
    outer, hole = geom.orient([square(0, 0, 4)[::-1], square(1, 1, 1)])
    assert geom.ring_area(outer) > 0 > geom.ring_area(hole)


def test_clip_polygon():
    inside = [square(0.2, 0.2, 0.5)]
    assert kernels.clip_polygon(inside, UNIT) is inside
    assert kernels.clip_polygon([square(5, 5, 1)], UNIT) is None
    cut = kernels.clip_polygon([square(0.5, 0.5, 2)], UNIT)
    assert geom.polygon_area(cut) == 0.25 and (cut[0][0] == cut[0][-1]).all()
    holed = kernels.clip_polygon([square(-1, -1, 4), square(0.25, 0.25, 0.5), square(2, 2, 0.5)], UNIT)
    assert len(holed) == 2 and geom.polygon_area(holed) == 0.75


def test_clip_by_kind():
    assert kernels.clip(Geometry(POINT, np.array([1.0, 1.0])), UNIT) and not kernels.clip(Geometry(POINT, np.array([1.1, 1.0])), UNIT)
    zig = Geometry(LINE, np.array([[-1, 0.5], [2, 0.5], [2, 0.7], [-1, 0.7]], float))
    assert kernels.clip(zig, UNIT).kind == MULTILINE
    assert kernels.clip(Geometry(LINE, np.array([[-1, 0.5], [2, 0.5]], float)), UNIT).data.tolist() == [[0, 0.5], [1, 0.5]]
    assert kernels.clip(Geometry(LINE, np.array([[2, 2], [3, 3]], float)), UNIT) is None
    both = Geometry(MULTIPOINT, np.array([[0.5, 0.5], [9, 9]], float))
    assert kernels.clip(both, UNIT) is both


@settings(max_examples=200, deadline=None)
@given(path)
def test_clipped_lines_stay_inside_and_lose_only_the_outside(line):
    runs = kernels.clip_line(line, UNIT)
    for r in runs:
        assert (r >= -1e-9).all() and (r <= 1 + 1e-9).all()
    t = np.linspace(0, 1, 400)
    dense = np.concatenate([a + t[:, None] * (b - a) for a, b in zip(line, line[1:])])
    within = ((dense >= 0) & (dense <= 1)).all(1).mean()
    total = np.hypot(*np.diff(line, axis=0).T).sum()
    steps = np.hypot(*np.diff(line, axis=0).T)
    approx = sum(s * ((((a + t[:, None] * (b - a)) >= 0) & ((a + t[:, None] * (b - a)) <= 1)).all(1).mean()) for s, a, b in zip(steps, line, line[1:]))
    assert abs(sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in runs) - approx) <= 0.02 * total + 1e-6
    assert within >= 0


@settings(max_examples=100, deadline=None)
@given(path, st.floats(0.01, 1))
def test_simplified_path(line, tolerance):
    out = kernels.simplify_path(line, tolerance)
    assert (out[0] == line[0]).all() and (out[-1] == line[-1]).all()
    assert {tuple(p) for p in out} <= {tuple(p) for p in line}
    for p in line:
        a, d = out[:-1], np.diff(out, axis=0)
        n = (d * d).sum(1)
        t = np.clip(((p - a) * d).sum(1) / np.where(n == 0, 1, n), 0, 1)
        assert np.hypot(*(p - a - t[:, None] * d).T).min() <= tolerance + 1e-9


def test_rings_keep_four_points():
    t = np.linspace(0, 2 * math.pi, 50)
    ring = np.stack([np.cos(t), np.sin(t)], 1) * 0.01
    ring[-1] = ring[0]
    assert len(kernels.simplify(Geometry(POLYGON, [ring]), 5.0).data[0]) == 4


def test_pixel_simplification_is_alike_at_all_latitudes():
    counts = set()
    for z, y in ((4, 7), (4, 3), (4, 1)):
        box = curves.tile_box(z, 5, y)
        t = np.linspace(0, 1, 200)
        line = np.stack([box[0] + t * (box[2] - box[0]), box[1] + (0.5 + 0.4 * np.sin(9 * t)) * (box[3] - box[1])], 1)
        counts.add(len(kernels.simplify_to_pixels(Geometry(LINE, line), box, 4096).data))
        back = kernels.simplify_in_pixels(Geometry(LINE, line), box, 4096).data
        assert np.allclose(back[0], line[0])
    assert len(counts) == 1


def test_validity():
    why = lambda g: (w.reason if (w := kernels.why_invalid(g)) else None)
    assert why(Geometry(LINE, np.zeros((1, 2)))) == "line_too_few_points"
    assert why(Geometry(POLYGON, [np.zeros((3, 2))])) == "polygon_too_few_points"
    assert kernels.why_invalid(Geometry(POLYGON, [square(0, 0, 4), np.zeros((2, 2))]))[1:] == (1, 2)
    assert why(Geometry(POLYGON, [square(0, 0, 1e-6)])) == "zero_area_polygon"
    assert why(Geometry(MULTIPOINT, np.zeros((0, 2)))) == "empty_geometry"
    assert why(Geometry(MULTILINE, [np.zeros((1, 2))])) == "no_valid_lines"
    assert why(Geometry(MULTIPOLYGON, [[np.zeros((1, 2))]])) == "no_valid_polygons"
    for g in SHAPES:
        assert why(g) is None
    one = kernels.keep_valid(Geometry(MULTILINE, [np.zeros((1, 2)), np.array([[0, 0], [1, 1]], float)]))
    assert one.kind == LINE
    assert kernels.keep_valid(Geometry(MULTIPOLYGON, [[square(0, 0, 1)], [square(0, 0, 1e-7)]])).kind == POLYGON


def test_dropping():
    world = curves.tile_box(0, 0, 0)
    assert not kernels.drops_point(5, 5, 123) and not kernels.drops_point(0, 14, 0)
    kept = [z for z in range(8) if not kernels.drops_point(z, 7, 77)]
    assert kept == list(range(kept[0], 8))
    share = sum(not kernels.drops_point(1, 3, i) for i in range(20000)) / 20000
    assert abs(share - 0.16) < 0.01
    assert kernels.drops_tiny_line(np.array([[0, 0], [0.01, 0]], float), world, 4096) and not kernels.drops_tiny_line(np.array([[-90, 0], [90, 0]], float), world, 4096)
    assert not kernels.drops_tiny_polygon([square(-10, -10, 20)], world, 4096)
    tiny = [[square(i / 7, i / 11, 0.1)] for i in range(2000)]
    chance = geom.polygon_area([kernels.to_pixels(world, 4096)(r) for r in tiny[0]]) / 4
    assert abs(sum(not kernels.drops_tiny_polygon(p, world, 4096) for p in tiny) / 2000 - chance) < 0.05
    assert kernels.lines_with_extent([np.zeros((2, 2))], world, 4096) is None
    assert not kernels.drops(SHAPES[6], 0, 14, 1, world, 4096)

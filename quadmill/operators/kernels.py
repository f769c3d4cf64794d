"""Clip, simplify, validate and drop: the per-tile geometry rules."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .geom import COLLECTION, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry, bbox, polygon_area, polygon_hash

Box = tuple[float, float, float, float]

#: Fixed values of the tiling rules.
MIN_LINE_POINTS = 2
MIN_RING_POINTS = 4
MIN_POLYGON_AREA = 1e-10  # square degrees
TINY_POLYGON_PIXELS = 4.0
SIMPLIFY_PIXELS = 1.0


def intersects(a: Box, b: Box) -> bool:
    return a[2] >= b[0] and a[0] <= b[2] and a[3] >= b[1] and a[1] <= b[3]


def buffered(b: Box, pixels: float, extent: int) -> Box:
    """The box enlarged by so many tile pixels, in degrees of its width on all sides."""
    d = (b[2] - b[0]) * pixels / extent
    return b[0] - d, b[1] - d, b[2] + d, b[3] + d


# --- clipping -------------------------------------------------------------------------------------------------------


def clip_line(line: np.ndarray, box: Box) -> list[np.ndarray]:
    """The runs of a line inside a closed box. Every segment's part inside is found at once; parts that meet are joined."""
    if len(line) < 2:
        return []
    p, d = line[:-1], np.diff(line, axis=0)
    t0, t1 = np.zeros(len(p)), np.ones(len(p))
    for axis in (0, 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (box[axis] - p[:, axis]) / d[:, axis]
            b = (box[axis + 2] - p[:, axis]) / d[:, axis]
        flat = d[:, axis] == 0
        out = flat & ((p[:, axis] < box[axis]) | (p[:, axis] > box[axis + 2]))
        lo, hi = np.where(flat, -np.inf, np.fmin(a, b)), np.where(flat, np.inf, np.fmax(a, b))
        t0, t1 = np.maximum(t0, lo), np.where(out, -np.inf, np.minimum(t1, hi))
    runs: list[list[np.ndarray]] = []
    joined = False
    for i in np.flatnonzero(t0 <= t1).tolist():
        start = line[i] if t0[i] == 0 else p[i] + t0[i] * d[i]
        end = line[i + 1] if t1[i] == 1 else p[i] + t1[i] * d[i]
        if not (runs and joined == i and t0[i] == 0):
            runs.append([start])
        runs[-1].append(end)
        joined = i + 1 if t1[i] == 1 else -1
    found = [np.array(r) for r in runs]
    return [r for r in found if (r != r[0]).any()]


def _clip_edge(ring: np.ndarray, axis: int, limit: float, keep_above: bool) -> np.ndarray:
    if not len(ring):
        return ring
    v = ring[:, axis]
    inside = v >= limit if keep_above else v <= limit
    if inside.all():
        return ring
    after = np.roll(ring, -1, 0)
    crosses = inside != np.roll(inside, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (limit - v) / (after[:, axis] - v)
        cut = ring + t[:, None] * (after - ring)
    cut[:, axis] = limit
    both = np.stack([ring, cut], 1).reshape(-1, 2)
    return both[np.stack([inside, crosses], 1).reshape(-1)]


def clip_ring(ring: np.ndarray, box: Box) -> np.ndarray:
    """A ring cut by the left, right, bottom and top edge in turn, closed again. Concave rings keep bridges along edges."""
    for axis, limit, above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        ring = _clip_edge(ring, axis, limit, above)
    if len(ring) and (ring[0] != ring[-1]).any():
        ring = np.concatenate([ring, ring[:1]])
    return ring


def clip_polygon(rings: list[np.ndarray], box: Box) -> list[np.ndarray] | None:
    own = bbox(Geometry(POLYGON, rings[:1])) if rings else None
    if own is None or not intersects(own, box):
        return None
    if own[0] >= box[0] and own[2] <= box[2] and own[1] >= box[1] and own[3] <= box[3]:
        return rings
    outer = clip_ring(rings[0], box)
    if len(outer) < 3:
        return None
    return [outer, *(r for r in (clip_ring(r, box) for r in rings[1:]) if len(r) >= 3)]


def clip(g: Geometry, box: Box) -> Geometry | None:
    """The part of a geometry in a box; MultiPoints and collections pass whole where the boxes meet."""
    kind, data = g
    if kind == POINT:
        return g if box[0] <= data[0] <= box[2] and box[1] <= data[1] <= box[3] else None
    if kind == LINE:
        runs = clip_line(data, box)
        return None if not runs else Geometry(LINE, runs[0]) if len(runs) == 1 else Geometry(MULTILINE, runs)
    if kind == MULTILINE:
        runs = [r for x in data for r in clip_line(x, box)]
        return Geometry(MULTILINE, runs) if runs else None
    if kind == POLYGON:
        rings = clip_polygon(data, box)
        return None if rings is None else Geometry(POLYGON, rings)
    if kind == MULTIPOLYGON:
        found = [p for p in (clip_polygon(x, box) for x in data) if p is not None]
        return Geometry(MULTIPOLYGON, found) if found else None
    own = bbox(g)
    return g if own is not None and intersects(own, box) else None


# --- simplification --------------------------------------------------------------------------------------------------


def simplify_path(path: np.ndarray, tolerance: float, least: int = 2) -> np.ndarray:
    """Ramer-Douglas-Peucker by distance to the segment. Both ends stay; fewer than `least` points are never left."""
    n = len(path)
    if n <= least or n < 3:
        return path
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    gaps = [(0, n - 1)]
    spare: list[tuple[float, int]] = []
    while gaps:
        a, b = gaps.pop()
        if b - a < 2:
            continue
        p, q, mid = path[a], path[b], path[a + 1 : b]
        d = q - p
        length = float(d @ d)
        t = np.clip(((mid - p) @ d) / length, 0, 1) if length else np.zeros(len(mid))
        far = np.hypot(*(mid - p - t[:, None] * d).T)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            gaps += [(a, a + 1 + i), (a + 1 + i, b)]
        elif least > 2:
            spare.append((float(far[i]), a + 1 + i))
    for _, i in sorted(spare, reverse=True)[: max(0, least - int(keep.sum()))]:
        keep[i] = True
    if keep.sum() < least:
        keep[np.flatnonzero(~keep)[: least - int(keep.sum())]] = True
    return path[keep]


def simplify(g: Geometry, tolerance: float) -> Geometry:
    """Lines and rings without the vertices that lie within the tolerance; points and collections stay."""
    kind, data = g
    if tolerance < 1e-10:
        return g
    if kind == LINE:
        return Geometry(kind, simplify_path(data, tolerance))
    if kind == MULTILINE:
        return Geometry(kind, [simplify_path(x, tolerance) for x in data])
    if kind == POLYGON:
        return Geometry(kind, [simplify_path(r, tolerance, MIN_RING_POINTS) for r in data])
    if kind == MULTIPOLYGON:
        return Geometry(kind, [[simplify_path(r, tolerance, MIN_RING_POINTS) for r in p] for p in data])
    return g


def transform(g: Geometry, f) -> Geometry:
    """The geometry with f applied to every coordinate array (n, 2)."""
    kind, data = g
    if kind == POINT:
        return Geometry(kind, f(data.reshape(1, 2))[0])
    if kind in (LINE, MULTIPOINT):
        return Geometry(kind, f(data))
    if kind in (POLYGON, MULTILINE):
        return Geometry(kind, [f(r) for r in data])
    if kind == MULTIPOLYGON:
        return Geometry(kind, [[f(r) for r in p] for p in data])
    return Geometry(kind, [transform(x, f) for x in data])


def to_pixels(box: Box, extent: int):
    """Degrees to unrounded tile pixels, y downward and linear in latitude."""

    def f(a: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        out[:, 0] = (a[:, 0] - box[0]) / (box[2] - box[0]) * extent
        out[:, 1] = (1.0 - (a[:, 1] - box[1]) / (box[3] - box[1])) * extent
        return out

    return f


def to_degrees(box: Box, extent: int):
    def f(a: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        out[:, 0] = box[0] + a[:, 0] / extent * (box[2] - box[0])
        out[:, 1] = box[1] + (1.0 - a[:, 1] / extent) * (box[3] - box[1])
        return out

    return f


def simplify_to_pixels(g: Geometry, box: Box, extent: int, tolerance: float = SIMPLIFY_PIXELS) -> Geometry:
    """Simplified in tile pixels, so alike at every latitude; the result stays in pixels."""
    return simplify(transform(g, to_pixels(box, extent)), tolerance)


def simplify_in_pixels(g: Geometry, box: Box, extent: int, tolerance: float = SIMPLIFY_PIXELS) -> Geometry:
    return g if g.kind in (POINT, MULTIPOINT, COLLECTION) else transform(simplify_to_pixels(g, box, extent, tolerance), to_degrees(box, extent))


# --- validity --------------------------------------------------------------------------------------------------------


class Invalid(NamedTuple):
    reason: str
    ring: int | None = None
    points: int | None = None


def _why_line(line: np.ndarray) -> Invalid | None:
    return Invalid("line_too_few_points", None, len(line)) if len(line) < MIN_LINE_POINTS else None


def _why_polygon(rings: list[np.ndarray]) -> Invalid | None:
    for i, r in enumerate(rings or [np.zeros((0, 2))]):
        if len(r) < MIN_RING_POINTS:
            return Invalid("polygon_too_few_points", i, len(r))
    return Invalid("zero_area_polygon") if abs(polygon_area(rings)) < MIN_POLYGON_AREA else None


def why_invalid(g: Geometry) -> Invalid | None:
    """None for a valid geometry, else the reason. Multi geometries are valid if any part is; collections always are."""
    kind, data = g
    if kind == LINE:
        return _why_line(data)
    if kind == POLYGON:
        return _why_polygon(data)
    if kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON) and not len(data):
        return Invalid("empty_geometry")
    if kind == MULTILINE and all(_why_line(x) for x in data):
        return Invalid("no_valid_lines")
    if kind == MULTIPOLYGON and all(_why_polygon(x) for x in data):
        return Invalid("no_valid_polygons")
    return None


def keep_valid(g: Geometry) -> Geometry | None:
    """The valid parts; a multi geometry with one part left becomes the single kind."""
    kind, data = g
    if kind in (MULTILINE, MULTIPOLYGON):
        why = _why_line if kind == MULTILINE else _why_polygon
        left = [x for x in data if not why(x)]
        return None if not left else Geometry(kind - 3, left[0]) if len(left) == 1 else Geometry(kind, left)
    return None if why_invalid(g) else g


# --- dropping --------------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def fmix64(x: int) -> int:
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _MASK
    return x ^ x >> 33


def drops_point(z: int, base_zoom: int, feature_id: int) -> bool:
    """Below the base zoom, 0.4 of the points stay for each zoom down; a MultiPoint goes by its feature as a whole."""
    return z < base_zoom and fmix64(feature_id) / 18446744073709551616.0 >= 0.4 ** (base_zoom - z)


def drops_tiny_polygon(rings: list[np.ndarray], tile: Box, extent: int, threshold: float = TINY_POLYGON_PIXELS) -> bool:
    """Polygons below the threshold stay with a chance of area over threshold, drawn from a hash of their coordinates."""
    area = polygon_area([to_pixels(tile, extent)(r) for r in rings])
    if area <= 0:
        return True
    return area < threshold and polygon_hash(rings) / 18446744073709551616.0 >= area / threshold


def drops_tiny_line(line: np.ndarray, tile: Box, extent: int) -> bool:
    if len(line) < 2:
        return True
    pixels = np.floor(to_pixels(tile, extent)(line))
    return bool((pixels == pixels[0]).all())


def lines_with_extent(lines: list[np.ndarray], tile: Box, extent: int) -> list[np.ndarray] | None:
    """The lines that do not collapse into a pixel; None if all do."""
    return [x for x in lines if not drops_tiny_line(x, tile, extent)] or None


def drops(g: Geometry, z: int, base_zoom: int, feature_id: int, tile: Box, extent: int) -> bool:
    """Whether a clipped geometry is left out at a zoom. Multi geometries go only if all parts go; collections never do."""
    kind, data = g
    if kind in (POINT, MULTIPOINT):
        return drops_point(z, base_zoom, feature_id)
    if kind == POLYGON:
        return drops_tiny_polygon(data, tile, extent)
    if kind == MULTIPOLYGON:
        return all(drops_tiny_polygon(x, tile, extent) for x in data)
    if kind == LINE:
        return drops_tiny_line(data, tile, extent)
    if kind == MULTILINE:
        return all(drops_tiny_line(x, tile, extent) for x in data)
    return False

"""Web-Mercator tile arithmetic as Column expressions.

Tiles are XYZ, y southward. Columns or plain values can be given for every argument. Tile columns and rows are clamped
into the grid, so longitude 180 and latitudes beyond the Mercator square fall into the border tiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENT = 4096


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def grid_size(z) -> Column:
    """Tiles in a row at zoom z, as bigint."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _c(z).cast("int"))


def tile_x(lng, z) -> Column:
    n = grid_size(z)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((_c(lng) + 180.0) / 360.0 * n))).cast("long")


def tile_y(lat, z) -> Column:
    n = grid_size(z)
    # beyond the square asinh(tan) still is finite; the clamp comes before the cast, which would overflow at the poles
    y = (F.lit(1.0) - F.asinh(F.tan(F.radians(_c(lat)))) / math.pi) / 2.0 * n
    return F.floor(F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), y))).cast("long")


def tile_bounds(z, x, y) -> Column:
    """struct(xmin, ymin, xmax, ymax) in degrees."""
    n = grid_size(z).cast("double")
    lng = lambda v: _c(v) / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh((F.lit(1.0) - _c(v) * 2.0 / n) * math.pi)))
    return F.struct(lng(x).alias("xmin"), lat(_c(y) + 1).alias("ymin"), lng(_c(x) + 1).alias("xmax"), lat(y).alias("ymax"))


def tile_ranges(xmin, ymin, xmax, ymax, z) -> Column:
    """array of struct(x0, x1, y0, y1), inclusive. A box that crosses the antimeridian (xmin > xmax) gives two."""
    y0, y1 = tile_y(ymax, z), tile_y(ymin, z)
    part = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    west, east = tile_x(xmin, z), tile_x(xmax, z)
    return F.when(_c(xmin) <= _c(xmax), F.array(part(west, east))).otherwise(F.array(part(west, grid_size(z) - 1), part(F.lit(0).cast("long"), east)))


def tiles_for_bbox(xmin, ymin, xmax, ymax, z) -> Column:
    """array of struct(x, y): all tiles that a box meets. Explode it; no join is needed."""
    xs = lambda r: F.sequence(r["x0"], r["x1"])
    ys = lambda r: F.sequence(r["y0"], r["y1"])
    tiles = F.transform(tile_ranges(xmin, ymin, xmax, ymax, z), lambda r: F.flatten(F.transform(ys(r), lambda y: F.transform(xs(r), lambda x: F.struct(x.alias("x"), y.alias("y"))))))
    return F.flatten(tiles)


def box_expand(a: Column, b: Column) -> Column:
    """The box around two boxes (structs of xmin, ymin, xmax, ymax); least and greatest skip nulls, so null is empty."""
    return F.struct(*[f(a[k], b[k]).alias(k) for k, f in (("xmin", F.least), ("ymin", F.least), ("xmax", F.greatest), ("ymax", F.greatest))])


def box_valid(b: Column) -> Column:
    return (b["xmin"] <= b["xmax"]) & (b["ymin"] <= b["ymax"])


def box_width(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def box_height(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def box_intersects(a: Column, b: Column) -> Column:
    """Closed boxes: a shared border counts."""
    return (a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"]) & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"])


def buffer_degrees(b: Column, pixels, extent=EXTENT) -> Column:
    """A buffer of so many tile pixels in degrees, from the tile's width."""
    return box_width(b) * _c(pixels) / _c(extent)


def box_buffer(b: Column, by: Column) -> Column:
    return F.struct((b["xmin"] - by).alias("xmin"), (b["ymin"] - by).alias("ymin"), (b["xmax"] + by).alias("xmax"), (b["ymax"] + by).alias("ymax"))


def hilbert(z, x, y) -> Column:
    """Position of tile x, y on the Hilbert curve of zoom z."""
    z, n = _c(z).cast("int"), grid_size(z)
    start = F.struct(_c(x).cast("long").alias("x"), _c(y).cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, i: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
        rx, ry = a["x"].bitwiseAND(s) != 0, a["y"].bitwiseAND(s) != 0
        quarter = F.when(rx & ~ry, 3).when(rx & ry, 2).when(ry, 1).otherwise(0)
        turned = ~ry & rx
        fx = F.when(turned, n - 1 - a["x"]).otherwise(a["x"])
        fy = F.when(turned, n - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry, a["x"]).otherwise(fy).alias("x"), F.when(ry, a["y"]).otherwise(fx).alias("y"), (a["d"] + s * s * quarter).alias("d"))

    steps = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda a: a["d"])


def tile_id(z, x, y) -> Column:
    """Archive id: tiles of the zooms before, then the Hilbert position."""
    before = ((F.call_function("shiftleft", F.lit(1).cast("long"), (_c(z) * 2).cast("int")) - 1) / 3).cast("long")
    return before + hilbert(z, x, y)


def world_coords(lng, lat) -> Column:
    """struct(wx, wy), 0 to 2^32 - 1 as bigint; latitude is held within 89.9, longitude wrapped once."""
    lng, lat = _c(lng), F.greatest(F.lit(-89.9), F.least(F.lit(89.9), _c(lat)))
    lng = F.when(lng < -180.0, lng + 360.0).when(lng > 180.0, lng - 360.0).otherwise(lng)
    r = F.radians(lat)
    top = float(1 << 32)
    hold = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(top - 1), v))).cast("long")
    wy = (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0 * top
    return F.struct(hold((lng + 180.0) / 360.0 * top).alias("wx"), hold(wy).alias("wy"))


def _spread(v: Column) -> Column:
    """Puts a zero before each of 32 bits."""
    for shift, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(m))
    return v


def _squeeze(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x5555555555555555))
    for shift, m in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(m))
    return v


def zorder(wx, wy) -> Column:
    """The 64 bits of the Z-order index, x before y, as a bigint of the same bits."""
    return F.shiftleft(_spread(_c(wx)), 1).bitwiseOR(_spread(_c(wy)))


def zorder_decode(key) -> Column:
    return F.struct(_squeeze(F.shiftrightunsigned(_c(key), 1)).alias("wx"), _squeeze(_c(key)).alias("wy"))


def unsigned_order(key) -> Column:
    """A bigint that sorts like the unsigned 64 bits of key: the sign bit flipped."""
    return _c(key).bitwiseXOR(F.lit(-(1 << 63)))


def pixel_ratio(lng, lat, b: Column) -> tuple[Column, Column]:
    return (_c(lng) - b["xmin"]) / box_width(b), (_c(lat) - b["ymin"]) / box_height(b)


def tile_pixel_f64(lng, lat, b: Column, extent=EXTENT) -> Column:
    """struct(px, py): unrounded tile pixels, linear in latitude."""
    x, y = pixel_ratio(lng, lat, b)
    return F.struct((x * _c(extent)).alias("px"), ((F.lit(1.0) - y) * _c(extent)).alias("py"))


def tile_pixel_round(lng, lat, b: Column, extent=EXTENT) -> Column:
    """Pixels rounded half away from zero, as encoding takes them."""
    p = tile_pixel_f64(lng, lat, b, extent)
    return F.struct(F.round(p["px"]).cast("int").alias("px"), F.round(p["py"]).cast("int").alias("py"))


def tile_pixel_floor(lng, lat, b: Column, extent=EXTENT) -> Column:
    """Pixels rounded down, as the test for collapsed lines takes them."""
    p = tile_pixel_f64(lng, lat, b, extent)
    return F.struct(F.floor(p["px"]).cast("int").alias("px"), F.floor(p["py"]).cast("int").alias("py"))


def pixel_to_geo(px, py, b: Column, extent=EXTENT) -> Column:
    e = _c(extent)
    return F.struct((b["xmin"] + _c(px) / e * box_width(b)).alias("lng"), (b["ymin"] + (F.lit(1.0) - _c(py) / e) * box_height(b)).alias("lat"))


def zigzag(n) -> Column:
    n = _c(n).cast("int")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 31))


def unzigzag(n) -> Column:
    n = _c(n).cast("int")
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(1))


def command(id_, count) -> Column:
    """MVT command integer: MoveTo 1, LineTo 2, ClosePath 7."""
    return _c(id_).cast("int").bitwiseAND(7).bitwiseOR(F.shiftleft(_c(count).cast("int"), 3))


def command_parts(c) -> Column:
    c = _c(c).cast("int")
    return F.struct(c.bitwiseAND(7).alias("id"), F.shiftrightunsigned(c, 3).alias("count"))


def point_commands(lng, lat, b: Column, extent=EXTENT) -> Column:
    p = tile_pixel_round(lng, lat, b, extent)
    return F.array(command(1, 1), zigzag(p["px"]), zigzag(p["py"]))


def density_cell(px, py, cell, extent=EXTENT) -> Column:
    """struct(cx, cy): the grid cell of a pixel, held within the grid."""
    last = F.floor(_c(extent) / _c(cell)) - 1
    hold = lambda v: F.least(F.floor(F.floor(F.greatest(_c(v), F.lit(0.0))) / _c(cell)), last).cast("int")
    return F.struct(hold(px).alias("cx"), hold(py).alias("cy"))


def density_drop_rate(z, max_zoom) -> Column:
    """Expected share dropped: all but one in 4 for each zoom below the last."""
    return F.when(_c(z) >= _c(max_zoom), F.lit(0.0)).otherwise(F.lit(1.0) - F.pow(F.lit(4.0), _c(z) - _c(max_zoom)))


def simplify_tolerance(z, extent=EXTENT) -> Column:
    """Degrees of a pixel at zoom z."""
    return F.lit(360.0) / grid_size(z) / _c(extent)

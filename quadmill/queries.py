"""Queries over the given tables, one or more for each operator, with the SQL that gives the same rows.

The tables have no geometry, so features are derived from events by integer arithmetic: points by event_id, boxes around
them, lines through each user's points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tilemath as tm
from .functions.hashing import fmix64, keep_point, retention_rate, unit_interval
from .operators import curves, geom, kernels, mvt
from .operators.geom import Geometry
from .plans.config import PropertyFilter, TileConfig
from .plans.tables import Tables, work_dir
from .plans.tiler import generate_single_tile, generate_tiles, number_features, prefix_sums, tile_runs, write_archive
from .sources.geoparquet import field_types
from .sources.pmtiles import register
from .sources.quality import inversion_rate

PI = repr(math.pi)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived features ------------------------------------------------------------------------------------------------


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "ts", "event_type", "value", ((F.col("event_id") * 7919 % 36000) / 100.0 - 180.0).alias("lng"), ((F.col("event_id") * 104729 % 16000) / 100.0 - 80.0).alias("lat"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    h = F.lit(0.01) + F.col("value") / 10000.0
    return points(spark, d).select("event_id", "lng", "lat", (F.col("lng") - h).alias("xmin"), (F.col("lat") - h).alias("ymin"), (F.col("lng") + h).alias("xmax"), (F.col("lat") + h).alias("ymax"))


def box_struct() -> "F.Column":
    return F.struct("xmin", "ymin", "xmax", "ymax")


P = "p AS (SELECT event_id, user_id, ts, event_type, value, (event_id * 7919 % 36000) / 100.0::DOUBLE - 180.0::DOUBLE AS lng, (event_id * 104729 % 16000) / 100.0::DOUBLE - 80.0::DOUBLE AS lat FROM events)"
B = P + ", b AS (SELECT event_id, lng, lat, lng - (0.01::DOUBLE + value / 10000.0::DOUBLE) AS xmin, lat - (0.01::DOUBLE + value / 10000.0::DOUBLE) AS ymin, lng + (0.01::DOUBLE + value / 10000.0::DOUBLE) AS xmax, lat + (0.01::DOUBLE + value / 10000.0::DOUBLE) AS ymax FROM p)"


def sx(lng: str, z: int) -> str:
    n = 1 << z
    return f"greatest(0, least({n - 1}, floor(({lng} + 180.0::DOUBLE) / 360.0::DOUBLE * {n})))::BIGINT"


def sy(lat: str, z: int) -> str:
    n = 1 << z
    return f"floor(greatest(0.0::DOUBLE, least({n - 1}::DOUBLE, (1.0::DOUBLE - asinh(tan(radians({lat}))) / {PI}::DOUBLE) / 2.0::DOUBLE * {n})))::BIGINT"


def sbox(z: int, x: str = "x", y: str = "y") -> str:
    n = f"{1 << z}::DOUBLE"
    lat = lambda v: f"degrees(atan(sinh((1.0::DOUBLE - {v} * 2.0::DOUBLE / {n}) * {PI}::DOUBLE)))"
    return f"{x} / {n} * 360.0::DOUBLE - 180.0::DOUBLE AS tx0, {lat(f'({y} + 1)')} AS ty0, ({x} + 1) / {n} * 360.0::DOUBLE - 180.0::DOUBLE AS tx1, {lat(y)} AS ty1"


def shilbert(source: str, z: int) -> str:
    """SQL over a source with x and y that adds tile_id."""
    n = 1 << z
    q = f"SELECT *, x AS hx, y AS hy, 0::BIGINT AS hd FROM {source}"
    for i in range(z - 1, -1, -1):
        s = 1 << i
        rx, ry = f"(hx & {s} <> 0)", f"(hy & {s} <> 0)"
        q = f"""SELECT * EXCLUDE (hx, hy, hd), CASE WHEN {ry} THEN hx WHEN {rx} THEN {n - 1} - hy ELSE hy END AS hx, CASE WHEN {ry} THEN hy WHEN {rx} THEN {n - 1} - hx ELSE hx END AS hy,
             hd + {s * s}::BIGINT * (CASE WHEN {rx} AND NOT {ry} THEN 3 WHEN {rx} THEN 2 WHEN {ry} THEN 1 ELSE 0 END) AS hd FROM ({q})"""
    return f"SELECT * EXCLUDE (hx, hy, hd), hd + {((1 << 2 * z) - 1) // 3}::BIGINT AS tile_id FROM ({q})"


SMIX = """m AS (SELECT *, event_id::UBIGINT AS h0 FROM p), m1 AS (SELECT *, xor(h0, h0 >> 33) AS h1 FROM m), m2 AS (SELECT *, ((h1::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h2 FROM m1),
m3 AS (SELECT *, xor(h2, h2 >> 33) AS h3 FROM m2), m4 AS (SELECT *, ((h3::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h4 FROM m3), m5 AS (SELECT *, xor(h4, h4 >> 33) AS h FROM m4)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- tile arithmetic -------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT event_id, {sx('lng', 10)} AS x, {sy('lat', 10)} AS y FROM p")
def tile_of_point(spark, d):
    return points(spark, d).select("event_id", tm.tile_x(F.col("lng"), 10).alias("x"), tm.tile_y(F.col("lat"), 10).alias("y"))


@query(f"WITH {P}, t AS (SELECT DISTINCT {sx('lng', 6)} AS x, {sy('lat', 6)} AS y FROM p), u AS (SELECT x, y, {sbox(6)} FROM t) SELECT x, y, round(tx0, 6) AS xmin, round(ty0, 6) AS ymin, round(tx1, 6) AS xmax, round(ty1, 6) AS ymax FROM u")
def tile_bounds(spark, d):
    t = points(spark, d).select(tm.tile_x(F.col("lng"), 6).alias("x"), tm.tile_y(F.col("lat"), 6).alias("y")).distinct()
    t = t.withColumn("b", tm.tile_bounds(6, F.col("x"), F.col("y")))
    return t.select("x", "y", *[F.round(f"b.{k}", 6).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {B}, r AS (SELECT event_id, {sx('xmin', 6)} AS x0, {sx('xmax', 6)} AS x1, {sy('ymax', 6)} AS y0, {sy('ymin', 6)} AS y1 FROM b), s AS (SELECT event_id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r) SELECT event_id, x, unnest(range(y0, y1 + 1)) AS y FROM s")
def tiles_of_box(spark, d):
    t = boxes(spark, d).select("event_id", F.explode(tm.tiles_for_bbox(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 6)).alias("t"))
    return t.select("event_id", "t.x", "t.y")


@query(f"WITH {P}, q AS (SELECT event_id, {sx('(170 + event_id % 10)::DOUBLE', 5)} AS w, {sx('(-180 + event_id % 7)::DOUBLE', 5)} AS e, {sy('lat', 5)} AS y0 FROM p) SELECT event_id, (32 - w + e + 1)::BIGINT AS n, (list_sum(range(w, 32)) + coalesce(list_sum(range(0, e + 1)), 0))::BIGINT AS sum_x FROM q")
def tiles_across_antimeridian(spark, d):
    p = points(spark, d).withColumns({"w": (170 + F.col("event_id") % 10).cast("double"), "e": (-180 + F.col("event_id") % 7).cast("double")})
    t = p.withColumn("t", tm.tiles_for_bbox(F.col("w"), F.col("lat"), F.col("e"), F.col("lat"), 5))
    return t.select("event_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["x"]).alias("sum_x"))


@query(f"WITH {P}, t AS (SELECT event_id, {sx('lng', 8)} AS x, {sy('lat', 8)} AS y FROM p) {shilbert('t', 8)}")
def tile_hilbert_id(spark, d):
    t = points(spark, d).select("event_id", tm.tile_x(F.col("lng"), 8).alias("x"), tm.tile_y(F.col("lat"), 8).alias("y"))
    return t.withColumn("tile_id", tm.tile_id(8, F.col("x"), F.col("y")))


@query(
    f"WITH {P}, w AS (SELECT event_id, floor((lng + 180.0::DOUBLE) / 360.0::DOUBLE * 4294967296.0::DOUBLE)::BIGINT AS wx, floor((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0::DOUBLE / cos(radians(lat))) / {PI}::DOUBLE) / 2.0::DOUBLE * 4294967296.0::DOUBLE)::BIGINT AS wy FROM p) SELECT event_id, wx, wy // 4096 AS wy_4096 FROM w"
)
def world_coords(spark, d):
    p = points(spark, d).withColumn("w", tm.world_coords(F.col("lng"), F.col("lat")))
    return p.select("event_id", "w.wx", F.expr("w.wy div 4096").alias("wy_4096"))


@query(f"WITH {P}, w AS (SELECT event_id, (event_id * 2654435761 % 4294967296)::BIGINT AS wx, (event_id * 40503 % 4294967296)::BIGINT AS wy FROM p) SELECT event_id, list_sum(list_transform(range(0, 32), lambda i: (((wx >> i) & 1)::HUGEINT * (1::HUGEINT << (2 * i + 1)) + ((wy >> i) & 1)::HUGEINT * (1::HUGEINT << (2 * i)))))::HUGEINT::VARCHAR AS zkey, wx, wy FROM w")
def zorder_key(spark, d):
    w = points(spark, d).select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("wx"), (F.col("event_id") * 40503 % 4294967296).alias("wy"))
    w = w.withColumn("k", tm.zorder(F.col("wx"), F.col("wy"))).withColumn("back", tm.zorder_decode(F.col("k")))
    return w.select("event_id", F.conv(F.hex("k"), 16, 10).alias("zkey"), "back.wx", "back.wy")


@query(f"WITH {P}, t AS (SELECT event_id, (event_id * 2654435761 % 4294967296)::BIGINT AS wx, (event_id * 40503 % 4294967296)::BIGINT AS wy FROM p) SELECT event_id, wx, wy FROM t")
def hilbert_world_roundtrip(spark, d):
    """Order 32, encoded and decoded by the Arrow kernels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = curves.hilbert_points(curves.hilbert_keys(b["wx"].to_numpy(), b["wy"].to_numpy()))
            yield pd.DataFrame({"event_id": b["event_id"], "wx": x.astype(np.int64), "wy": y.astype(np.int64)})

    w = points(spark, d).select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("wx"), (F.col("event_id") * 40503 % 4294967296).alias("wy"))
    return w.mapInPandas(run, "event_id long, wx long, wy long")


@query(f"WITH {B}, t AS (SELECT *, {sx('lng', 6)} AS x, {sy('lat', 6)} AS y FROM b), u AS (SELECT *, {sbox(6)} FROM t) SELECT event_id, round(xmax - xmin, 9) AS width, round(ymax - ymin, 9) AS height, round(least(xmin, tx0), 6) AS exp_xmin, round(greatest(ymax, ty1), 6) AS exp_ymax, xmax >= tx0 AND xmin <= tx1 AND ymax >= ty0 AND ymin <= ty1 AS meets, round((tx1 - tx0) * 8 / 4096, 9) AS buffer_deg FROM u")
def box_algebra(spark, d):
    b = boxes(spark, d).withColumn("b", box_struct())
    t = tm.tile_bounds(6, tm.tile_x(F.col("lng"), 6), tm.tile_y(F.col("lat"), 6))
    b = b.withColumn("t", t).withColumn("u", tm.box_expand(F.col("b"), F.col("t")))
    c = F.col
    return b.select("event_id", F.round(tm.box_width(c("b")), 9).alias("width"), F.round(tm.box_height(c("b")), 9).alias("height"), F.round("u.xmin", 6).alias("exp_xmin"), F.round("u.ymax", 6).alias("exp_ymax"), tm.box_intersects(c("b"), c("t")).alias("meets"), F.round(tm.buffer_degrees(c("t"), 8), 9).alias("buffer_deg"))


@query(f"WITH {P}, t AS (SELECT *, {sx('lng', 3)} AS x, {sy('lat', 3)} AS y FROM p), u AS (SELECT *, {sbox(3)} FROM t), v AS (SELECT *, (lng - tx0) / (tx1 - tx0) * 4096 AS fx, (1.0::DOUBLE - (lat - ty0) / (ty1 - ty0)) * 4096 AS fy FROM u) SELECT event_id, round(fx, 4) AS fx, round(fy, 4) AS fy, round(lng, 6) AS lng_back, round(lat, 6) AS lat_back FROM v")
def tile_pixels(spark, d):
    p = points(spark, d).withColumn("t", tm.tile_bounds(3, tm.tile_x(F.col("lng"), 3), tm.tile_y(F.col("lat"), 3)))
    p = p.withColumn("f", tm.tile_pixel_f64(F.col("lng"), F.col("lat"), F.col("t"))).withColumn("g", tm.pixel_to_geo(F.col("f.px"), F.col("f.py"), F.col("t")))
    return p.select("event_id", F.round("f.px", 4).alias("fx"), F.round("f.py", 4).alias("fy"), F.round("g.lng", 6).alias("lng_back"), F.round("g.lat", 6).alias("lat_back"))


@query(f"WITH {P}, v AS (SELECT event_id, (event_id % 4001 - 2000)::INT AS n FROM p) SELECT event_id, (CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END)::INT AS z, n AS back, (1 + event_id % 100 * 8)::INT AS cmd, 1::INT AS cmd_id, (event_id % 100)::INT AS cmd_count FROM v")
def zigzag_commands(spark, d):
    v = points(spark, d).select("event_id", (F.col("event_id") % 4001 - 2000).cast("int").alias("n")).withColumn("z", tm.zigzag(F.col("n")))
    v = v.withColumn("cmd", tm.command(1, F.col("event_id") % 100)).withColumn("c", tm.command_parts(F.col("cmd")))
    return v.select("event_id", "z", tm.unzigzag(F.col("z")).alias("back"), "cmd", F.col("c.id").alias("cmd_id"), F.col("c.count").alias("cmd_count"))


@query(f"WITH {P}, t AS (SELECT *, {sx('lng', 5)} AS x, {sy('lat', 5)} AS y FROM p), u AS (SELECT *, {sbox(5)} FROM t), v AS (SELECT event_id, round((lng - tx0) / (tx1 - tx0) * 256)::INT AS px, round((1.0::DOUBLE - (lat - ty0) / (ty1 - ty0)) * 256)::INT AS py FROM u) SELECT event_id, '9,' || (2 * px) || ',' || (2 * py) AS cmds FROM v")
def point_mvt_commands(spark, d):
    p = points(spark, d).withColumn("t", tm.tile_bounds(5, tm.tile_x(F.col("lng"), 5), tm.tile_y(F.col("lat"), 5)))
    c = tm.point_commands(F.col("lng"), F.col("lat"), F.col("t"), 256)
    return p.select("event_id", F.array_join(c.cast("array<string>"), ",").alias("cmds"))


# --- thinning and density --------------------------------------------------------------------------------------------


@query(f"WITH {P}, {SMIX}, z AS (SELECT unnest(range(0, 5))::INT AS z) SELECT event_id, z FROM m5, z WHERE z >= 4 OR h::DOUBLE / 18446744073709551616.0::DOUBLE < pow(0.4::DOUBLE, 4 - z)")
def point_thinning(spark, d):
    p = points(spark, d).select("event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("z"))
    return p.where(keep_point(F.col("event_id"), F.col("z"), 4))


@query(f"WITH {P}, {SMIX} SELECT event_id, h::VARCHAR AS mixed, round(h::DOUBLE / 18446744073709551616.0::DOUBLE, 12) AS unit FROM m5")
def point_hash(spark, d):
    p = points(spark, d).withColumn("h", fmix64(F.col("event_id")))
    return p.select("event_id", F.conv(F.hex("h"), 16, 10).alias("mixed"), F.round(unit_interval(F.col("h")), 12).alias("unit"))


@query("SELECT z::INT AS z, round(CASE WHEN z >= 10 THEN 1.0::DOUBLE ELSE pow(0.4::DOUBLE, 10 - z) END, 12) AS rate, round(CASE WHEN z >= 10 THEN 0.0::DOUBLE ELSE 1 - pow(4.0::DOUBLE, z - 10) END, 12) AS drop_rate, round(360.0::DOUBLE / pow(2, z) / 4096, 12) AS tolerance FROM range(0, 15) t(z)")
def rate_table(spark, d):
    z = spark.range(0, 15, 1, 1).select(F.col("id").cast("int").alias("z"))
    return z.select("z", F.round(retention_rate(F.col("z"), 10), 12).alias("rate"), F.round(tm.density_drop_rate(F.col("z"), 10), 12).alias("drop_rate"), F.round(tm.simplify_tolerance(F.col("z")), 12).alias("tolerance"))


@query(f"WITH {P}, t AS (SELECT *, {sx('lng', 4)} AS x, {sy('lat', 4)} AS y FROM p), u AS (SELECT *, {sbox(4)} FROM t), v AS (SELECT event_id, x, y, least(floor(floor(greatest((lng - tx0) / (tx1 - tx0) * 4096, 0)) / 128), 31)::INT AS cx, least(floor(floor(greatest((1.0::DOUBLE - (lat - ty0) / (ty1 - ty0)) * 4096, 0)) / 128), 31)::INT AS cy FROM u) SELECT event_id, x, y FROM v QUALIFY row_number() OVER (PARTITION BY x, y, cx, cy ORDER BY event_id) <= 2")
def density_topn(spark, d):
    p = points(spark, d).select("event_id", "lng", "lat", tm.tile_x(F.col("lng"), 4).alias("x"), tm.tile_y(F.col("lat"), 4).alias("y"))
    p = p.withColumn("f", tm.tile_pixel_f64(F.col("lng"), F.col("lat"), tm.tile_bounds(4, F.col("x"), F.col("y"))))
    p = p.withColumn("c", tm.density_cell(F.col("f.px"), F.col("f.py"), 128))
    w = Window.partitionBy("x", "y", "c.cx", "c.cy").orderBy("event_id")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 2").select("event_id", "x", "y")


# --- geometry kernels ------------------------------------------------------------------------------------------------


def _ring(x0, y0, x1, y1) -> np.ndarray:
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)


def box_wkb(df: DataFrame, keep: str = "event_id") -> DataFrame:
    """(keep, wkb): boxes as polygons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({keep: b[keep], "wkb": [geom.to_wkb(Geometry(geom.POLYGON, [_ring(*r)])) for r in b[["xmin", "ymin", "xmax", "ymax"]].itertuples(index=False)]})

    return df.select(keep, "xmin", "ymin", "xmax", "ymax").mapInPandas(run, f"{keep} long, wkb binary")


@query(f"WITH {B}, t AS (SELECT *, {sx('lng', 9)} AS x, {sy('lat', 9)} AS y FROM b), u AS (SELECT *, {sbox(9)} FROM t), v AS (SELECT *, (tx1 - tx0) * 8 / 4096 AS bd FROM u), c AS (SELECT *, greatest(0, least(xmax, tx1 + bd) - greatest(xmin, tx0 - bd)) AS w, greatest(0, least(ymax, ty1 + bd) - greatest(ymin, ty0 - bd)) AS h FROM v) SELECT event_id, round(w * h, 8) AS area, round((w / (tx1 - tx0) * 4096) * (h / (ty1 - ty0) * 4096), 2) AS area_px FROM c")
def clip_boxes(spark, d):
    """Polygon clipping by the kernel; the SQL has boxes in closed form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                tile = curves.tile_box(9, *curves.tile_of(r.lng, r.lat, 9))
                rings = kernels.clip_polygon([_ring(r.xmin, r.ymin, r.xmax, r.ymax)], kernels.buffered(tile, 8, 4096))
                px = [kernels.to_pixels(tile, 4096)(x) for x in rings or []]
                out.append((r.event_id, round(geom.polygon_area(rings or []), 8), round(geom.polygon_area(px), 2)))
            yield pd.DataFrame(out, columns=["event_id", "area", "area_px"])

    return boxes(spark, d).mapInPandas(run, "event_id long, area double, area_px double")


@query(f"WITH {P}, t AS (SELECT *, {sx('lng', 7)} AS x, {sy('lat', 7)} AS y FROM p), u AS (SELECT *, {sbox(7)} FROM t) SELECT event_id, (lng + 0.02::DOUBLE BETWEEN tx0 AND tx1) AND (lat BETWEEN ty0 AND ty1) AS inside FROM u")
def clip_points(spark, d):
    p = points(spark, d).withColumn("t", tm.tile_bounds(7, tm.tile_x(F.col("lng"), 7), tm.tile_y(F.col("lat"), 7)))
    return p.select("event_id", ((F.col("lng") + 0.02).between(F.col("t.xmin"), F.col("t.xmax")) & F.col("lat").between(F.col("t.ymin"), F.col("t.ymax"))).alias("inside"))


@query(f"WITH {B}, t AS (SELECT *, {sx('lng', 8)} AS x, {sy('lat', 8)} AS y FROM b), u AS (SELECT *, {sbox(8)} FROM t), v AS (SELECT event_id, (xmax - xmin) / (tx1 - tx0) * 4096 * ((ymax - ymin) / (ty1 - ty0) * 4096) AS a FROM u) SELECT event_id, round(a, 4) AS area_px, a < 4 AS tiny, round(least(1.0::DOUBLE, a / 4), 6) AS keep_chance FROM v")
def tiny_polygon_candidates(spark, d):
    b = boxes(spark, d).withColumn("t", tm.tile_bounds(8, tm.tile_x(F.col("lng"), 8), tm.tile_y(F.col("lat"), 8)))
    a = (F.col("xmax") - F.col("xmin")) / tm.box_width(F.col("t")) * 4096 * ((F.col("ymax") - F.col("ymin")) / tm.box_height(F.col("t")) * 4096)
    b = b.withColumn("a", a)
    return b.select("event_id", F.round("a", 4).alias("area_px"), (F.col("a") < 4).alias("tiny"), F.round(F.least(F.lit(1.0), F.col("a") / 4), 6).alias("keep_chance"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, pts): each user's points by time, gathered per user."""
    pts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "lng", "lat")))
    return points(spark, d).groupBy("user_id").agg(pts.alias("pts"))


@query(f"WITH {P}, q AS (SELECT user_id, floor((lng + 180.0::DOUBLE) / 360.0::DOUBLE * 4) AS px, floor((1.0::DOUBLE - (lat + 85.0511287798066::DOUBLE) / 170.1022575596132::DOUBLE) * 4) AS py FROM p) SELECT user_id, count(*)::BIGINT AS n, count(*) < 2 OR count(DISTINCT px * 100 + py) = 1 AS dropped FROM q GROUP BY user_id")
def tiny_lines(spark, d):
    """Lines that fall into one pixel of a tile with four pixels a side, by the kernel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        world = (-180.0, -85.0511287798066, 180.0, 85.0511287798066)
        for b in batches:
            shapes = [np.array([(p["lng"], p["lat"]) for p in pts], float).reshape(-1, 2) for pts in b["pts"]]
            yield pd.DataFrame({"user_id": b["user_id"], "n": [len(x) for x in shapes], "dropped": [kernels.drops_tiny_line(x, world, 4) for x in shapes]})

    return lines(spark, d).mapInPandas(run, "user_id long, n long, dropped boolean")


@query(f"WITH {P}, c AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id), k AS (SELECT CASE WHEN n % 5 = 0 THEN 'zero_area_polygon' WHEN n % 5 = 1 THEN 'line_too_few_points' WHEN n % 5 = 2 THEN 'polygon_too_few_points' WHEN n % 5 = 3 THEN 'empty_geometry' ELSE 'valid' END AS reason FROM c) SELECT reason, count(*)::BIGINT AS n FROM k GROUP BY reason")
def validity_counts(spark, d):
    """Shapes good and bad by each user's number of points, judged by the kernel."""
    z = np.zeros((0, 2))
    made = [Geometry(geom.POLYGON, [np.zeros((5, 2))]), Geometry(geom.LINE, np.zeros((1, 2))), Geometry(geom.POLYGON, [np.zeros((3, 2))]), Geometry(geom.MULTIPOINT, z), Geometry(geom.POLYGON, [_ring(0, 0, 1, 1)])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            why = [kernels.why_invalid(made[n % 5]) for n in b["n"]]
            yield pd.DataFrame({"reason": [w.reason if w else "valid" for w in why]})

    return points(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).mapInPandas(run, "reason string").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {B} SELECT event_id, round(lng, 6) AS cx, round(lat, 6) AS cy, round(xmin, 9) AS xmin, round(ymax, 9) AS ymax, true AS ccw FROM b")
def wkb_centroid_bbox(spark, d):
    """Boxes to WKB and back; center, box and orientation by the kernels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, raw in zip(b["event_id"], b["wkb"]):
                g = geom.from_wkb(raw)
                c, box = geom.centroid(g), geom.bbox(g)
                out.append((i, round(c[0], 6), round(c[1], 6), round(box[0], 9), round(box[3], 9), geom.ring_area(geom.orient(g.data)[0]) > 0))
            yield pd.DataFrame(out, columns=["event_id", "cx", "cy", "xmin", "ymax", "ccw"])

    return box_wkb(boxes(spark, d)).mapInPandas(run, "event_id long, cx double, cy double, xmin double, ymax double, ccw boolean")


def line_wkb(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [np.array([(p["lng"], p["lat"]) for p in pts], float).reshape(-1, 2) for pts in b["pts"]]
            yield pd.DataFrame({"user_id": b["user_id"], "n": [len(x) for x in shapes], "wkb": [geom.to_wkb(Geometry(geom.LINE, x)) for x in shapes]})

    return lines(spark, d).mapInPandas(run, "user_id long, n long, wkb binary")


@query()
def simplify_lines(spark, d):
    """Vertices before and after simplification at zoom 2, and the largest distance from the simplified line in degrees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n, raw in b[["user_id", "n", "wkb"]].itertuples(index=False):
                g = geom.from_wkb(raw)
                out.append((i, n, len(kernels.simplify(g, 360.0 / 4 / 4096).data), len(kernels.simplify(g, 45.0).data)))
            yield pd.DataFrame(out, columns=["user_id", "n", "n_fine", "n_coarse"])

    return line_wkb(spark, d).mapInPandas(run, "user_id long, n long, n_fine long, n_coarse long")


@query()
def clip_lines(spark, d):
    """Parts and length of each user's line in the north-western tile of zoom 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = kernels.buffered(curves.tile_box(1, 0, 0), 8, 4096)
        for b in batches:
            runs = [kernels.clip_line(geom.from_wkb(raw).data, box) for raw in b["wkb"]]
            length = [round(float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in x)), 6) for x in runs]
            yield pd.DataFrame({"user_id": b["user_id"], "n_parts": [len(x) for x in runs], "length": length})

    return line_wkb(spark, d).mapInPandas(run, "user_id long, n_parts long, length double")


# --- aggregates, order, archive --------------------------------------------------------------------------------------


@query(f"WITH {B} SELECT round(min(xmin), 6) AS xmin, round(min(ymin), 6) AS ymin, round(max(xmax), 6) AS xmax, round(max(ymax), 6) AS ymax FROM b")
def dataset_bbox(spark, d):
    return boxes(spark, d).agg(*[F.round(f(k), 6).alias(k) for f, k in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])


@query(f"WITH {P}, {SMIX}, t AS (" + " UNION ALL ".join(f"SELECT {z}::INT AS z, {sx('lng', z)} AS x, {sy('lat', z)} AS y FROM m5 WHERE {z} >= 5 OR h::DOUBLE / 18446744073709551616.0::DOUBLE < pow(0.4::DOUBLE, {5 - z})" for z in range(6)) + ") SELECT z, count(*)::BIGINT AS n_features, count(DISTINCT x * 100000 + y)::BIGINT AS n_tiles FROM t GROUP BY z")
def tile_stats_by_zoom(spark, d):
    p = points(spark, d).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(5)))).where(keep_point(F.col("event_id"), F.col("z"), 5))
    t = p.groupBy("z", tm.tile_x(F.col("lng"), F.col("z")).alias("x"), tm.tile_y(F.col("lat"), F.col("z")).alias("y")).agg(F.count("*").alias("n"))
    return t.groupBy("z").agg(F.sum("n").alias("n_features"), F.count("*").alias("n_tiles"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """(tile_id, payload): a coarse picture of each tile of zoom 7, so that tiles have equal contents."""
    p = points(spark, d).select("lng", "lat", tm.tile_x(F.col("lng"), 7).alias("x"), tm.tile_y(F.col("lat"), 7).alias("y"))
    p = p.withColumn("tile_id", tm.tile_id(7, F.col("x"), F.col("y")))
    return p.groupBy("tile_id").agg(F.repeat(F.lit("x"), F.least(F.count("*"), F.lit(6)).cast("int")).alias("payload"))


PAY = f"WITH {P}, q AS (SELECT {sx('lng', 7)} AS x, {sy('lat', 7)} AS y FROM p), r AS ({shilbert('q', 7)}), t AS (SELECT tile_id, repeat('x', least(count(*), 6)) AS payload FROM r GROUP BY tile_id), f AS (SELECT payload, min(tile_id) AS first_id, length(payload)::BIGINT AS length FROM t GROUP BY payload), o AS (SELECT *, coalesce(sum(length) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM f)"


@query(PAY + " SELECT count(*)::BIGINT AS total, count(DISTINCT payload)::BIGINT AS n_unique, round(1 - count(DISTINCT payload) / count(*)::DOUBLE, 9) AS ratio FROM t")
def tile_dedup(spark, d):
    t = payloads(spark, d).groupBy("payload").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"))
    return t.withColumn("ratio", F.round(1 - F.col("n_unique") / F.col("total"), 9))


def _offsets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = Tables(spark)
    t = tables.save(payloads(spark, d))
    unique = tables.save(t.groupBy(F.col("payload").alias("hash")).agg(F.min("tile_id").alias("first_id"), F.length("payload").cast("long").alias("length")))
    return t, prefix_sums(unique, tables)


@query(PAY + ' SELECT first_id, length, "offset" FROM o')
def tile_offsets(spark, d):
    return _offsets(spark, d)[1].select("first_id", "length", "offset")


@query(PAY + ', g AS (SELECT tile_id, length, "offset", tile_id - row_number() OVER (PARTITION BY "offset" ORDER BY tile_id) AS run FROM t JOIN o USING (payload)), e AS (SELECT min(tile_id) AS tile_id, count(*)::BIGINT AS run_length, "offset", length FROM g GROUP BY "offset", length, run) SELECT tile_id, run_length, "offset", length, tile_id - coalesce(lag(tile_id) OVER (ORDER BY tile_id), 0) AS delta, coalesce(lag("offset" + length) OVER (ORDER BY tile_id) = "offset", false) AS contiguous FROM e')
def tile_directory(spark, d):
    t, placed = _offsets(spark, d)
    e = tile_runs(t.join(placed, t.payload == placed.hash).select("tile_id", "offset", "length"))
    w = Window.orderBy("tile_id")  # a directory is one sequence; the sink does this while it writes
    return e.withColumns({"delta": F.col("tile_id") - F.coalesce(F.lag("tile_id").over(w), F.lit(0)), "contiguous": F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset"), F.lit(False))})


@query("SELECT * FROM (VALUES ('c_acctbal', 'Number'), ('c_custkey', 'Number'), ('c_mktsegment', 'String'), ('c_name', 'String'), ('c_nationkey', 'Number')) t(field, kind)")
def field_metadata(spark, d):
    kinds = field_types(table(spark, d, "customer").schema)
    return spark.createDataFrame(sorted(kinds.items()), "field string, kind string")


@query("SELECT c_custkey, c_mktsegment, c_name FROM customer")
def property_projection(spark, d):
    c = table(spark, d, "customer")
    return c.select(PropertyFilter.of(exclude=["c_acctbal", "c_nationkey", "unknown"]).filter_fields(c.columns))


@query(f"WITH {P}, t AS (SELECT event_id, {sx('lng', 8)} AS x, {sy('lat', 8)} AS y FROM p WHERE event_id < 1000), h AS ({shilbert('t', 8)}), l AS (SELECT tile_id, lag(tile_id) OVER (ORDER BY event_id) AS before FROM h) SELECT round(sum((tile_id < before)::INT) / count(*)::DOUBLE, 9) AS inversion_rate FROM l")
def sortedness_rate(spark, d):
    """The diagnosis reads the first thousand rows of a file; here those of the smallest ids."""
    t = points(spark, d).where("event_id < 1000").select("event_id", tm.tile_id(8, tm.tile_x(F.col("lng"), 8), tm.tile_y(F.col("lat"), 8)).alias("k"))
    return inversion_rate(t, "k", "event_id").select(F.round("inversion_rate", 9).alias("inversion_rate"))


@query(f"WITH {P}, t AS (SELECT event_id, {sx('lng', 6)} AS x, {sy('lat', 6)} AS y FROM p), h AS ({shilbert('t', 6)}) SELECT event_id, (row_number() OVER (ORDER BY tile_id, event_id) - 1)::BIGINT AS feature_id FROM h")
def feature_ids(spark, d):
    """Ranks along the curve by range partitions and offsets. The id stands in for the geometry as the tie-break."""
    t = points(spark, d).select("event_id", tm.tile_id(6, tm.tile_x(F.col("lng"), 6), tm.tile_y(F.col("lat"), 6)).alias("k"))
    keyed = t.select((F.col("k") * 100_000_000 + F.col("event_id")).alias("key"), F.lit(b"").alias("wkb"), F.col("event_id").cast("string").cast("binary").alias("props"))
    return number_features(keyed, Tables(spark)).select(F.col("props").cast("string").cast("long").alias("event_id"), "feature_id")


# --- the whole job ---------------------------------------------------------------------------------------------------


def mixed_features(spark: SparkSession, d: str) -> DataFrame:
    """Points, boxes and lines with attributes, as a table with a WKB column."""

    def point_wkb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = np.zeros(len(b), [("o", "u1"), ("k", "<u4"), ("x", "<f8"), ("y", "<f8")])
            raw["o"], raw["k"], raw["x"], raw["y"] = 1, 1, b["lng"], b["lat"]
            yield pd.DataFrame({"geometry": [r.tobytes() for r in raw], "kind": "point", "num": b["event_id"], "value": b["value"]})

    shape = "geometry binary, kind string, num long, value double"
    p = points(spark, d).select("event_id", "lng", "lat", "value").mapInPandas(point_wkb, shape)
    b = boxes(spark, d)
    b = box_wkb(b.withColumns({k: F.col(k) + (F.col(c) - F.col(k)) * -20 for k, c in (("xmin", "lng"), ("xmax", "lng"), ("ymin", "lat"), ("ymax", "lat"))}))
    b = b.select(F.col("wkb").alias("geometry"), F.lit("box").alias("kind"), F.col("event_id").alias("num"), F.lit(None).cast("double").alias("value"))
    x = line_wkb(spark, d).select(F.col("wkb").alias("geometry"), F.lit("line").alias("kind"), F.col("user_id").alias("num"), F.lit(None).cast("double").alias("value"))
    return p.union(b).union(x)


def point_features(spark: SparkSession, d: str) -> DataFrame:
    return mixed_features(spark, d).where("kind = 'point'")


@query(f"WITH {P}, t AS (SELECT {sx('lng', 5)} AS x, {sy('lat', 5)} AS y FROM p) SELECT 5 AS z, x, y, count(*)::BIGINT AS feature_count FROM t GROUP BY x, y")
def encode_point_tiles(spark, d):
    """Points through the whole job at their base zoom, where all stay; read back from the encoded tiles."""
    tiles = generate_tiles(point_features(spark, d), TileConfig(5, 5, buffer=0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"z": b["z"], "x": b["x"], "y": b["y"], "feature_count": [len(mvt.decode(t)[0]["features"]) for t in b["data"]]})

    return tiles.mapInPandas(run, "z int, x long, y long, feature_count long")


@query()
def encode_tiles_mixed(spark, d):
    """All kinds of features, zooms 0 to 4: tiles, features and bytes by zoom."""
    tiles = generate_tiles(mixed_features(spark, d), TileConfig(0, 4))
    return tiles.groupBy("z").agg(F.count("*").alias("n_tiles"), F.sum("feature_count").alias("n_features"), F.sum(F.octet_length("data")).alias("n_bytes"))


@query()
def encode_tiles_density(spark, d):
    """The same with the density limit, per-zoom simplification and buffered reach."""
    c = TileConfig(0, 4, max_per_cell=1, cell_size=64, simplify_mode="per_zoom", tile_reach="buffered_bbox", curve="zorder")
    return generate_tiles(mixed_features(spark, d), c).groupBy("z").agg(F.count("*").alias("n_tiles"), F.sum("feature_count").alias("n_features"))


@query()
def single_tile(spark, d):
    return generate_single_tile(mixed_features(spark, d), 2, 1, 1, TileConfig(0, 4)).select("tile_id", "z", "x", "y", "feature_count", F.octet_length("data").alias("n_bytes"))


@query(f"WITH {P}, i AS (SELECT {sx('lng', 3)} AS x, {sy('lat', 3)} AS y FROM p) SELECT x, y, count(*)::BIGINT AS n FROM i GROUP BY x, y")
def pmtiles_roundtrip(spark, d):
    """Written as an archive of zoom 3 and read again through the source."""
    register(spark)
    path = f"{work_dir(spark).removeprefix('file://')}/roundtrip-{abs(hash(d))}.pmtiles"
    write_archive(point_features(spark, d), path, TileConfig(3, 3, buffer=0), "zstd")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": b["x"], "y": b["y"], "n": [len(mvt.decode(t)[0]["features"]) for t in b["data"]]})

    return spark.read.format("pmtiles").load(path).mapInPandas(run, "x long, y long, n long")

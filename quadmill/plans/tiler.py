"""Features to tiles to an archive.

scan (pruned) -> box and curve key -> feature ids -> work units by generate -> clip and encode -> [density] -> range
exchange by tile -> tiles -> first of equal contents, offsets, runs -> sink
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tilemath as tm
from ..functions.hashing import keep_point
from ..operators import curves, geom, kernels, mvt
from ..operators.pmtiles import ArchiveInfo, Codec, compress
from ..sources.geoparquet import features, field_types
from ..sources.pmtiles import register
from .config import TileConfig
from .tables import Tables

#: Tiles in a work unit, about. Large features become many units, so that none holds a task alone.
UNIT_TILES = 512


def _keyed(config: TileConfig, fields: list[str], kinds: dict[str, str]):
    """For mapInPandas: box, curve key and packed attributes of each feature; those without a box are left out."""
    as_is = {c: np.float32 if kinds[c] == "float" else int if kinds[c].startswith("decimal") else None for c in fields}

    def pack(row: tuple) -> bytes:
        out = bytearray()
        for i, v in enumerate(row):
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                continue
            cast = as_is[fields[i]]
            value = mvt.value_message(np.uint64(int(v)) if cast is int else cast(v) if cast else v)
            out += mvt.varint(i) + mvt.varint(len(value)) + value
        return bytes(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [geom.from_wkb(v) for v in b["wkb"]]
            boxes = [geom.bbox(g) for g in shapes]
            at = [i for i, x in enumerate(boxes) if x is not None]
            box = np.array([boxes[i] for i in at], float).reshape(-1, 4)
            mid = [geom.centroid(shapes[i]) or ((boxes[i][0] + boxes[i][2]) / 2, (boxes[i][1] + boxes[i][3]) / 2) for i in at]
            mid = np.array(mid, float).reshape(-1, 2)
            wx, wy = curves.world(mid[:, 0], mid[:, 1])
            key = (curves.hilbert_keys if config.curve == "hilbert" else curves.zorder_keys)(wx, wy)
            rows = [tuple(r) for r in b[fields].astype(object).where(b[fields].notna(), None).itertuples(index=False)] if fields else []
            props = [pack(rows[i]) for i in at] if fields else [b""] * len(at)
            yield pd.DataFrame({"kind": np.array([shapes[i].kind for i in at], np.int32), "key": curves.as_sortable(key), "wkb": b["wkb"].iloc[at].tolist(), "xmin": box[:, 0], "ymin": box[:, 1], "xmax": box[:, 2], "ymax": box[:, 3], "props": props})

    return run


def number_features(keyed: DataFrame, tables: Tables) -> DataFrame:
    """Adds feature_id, the rank by (key, wkb, props) from 0. Range partitions are sorted and written once, with each row's
    place in its partition; the counts of the partitions before give the offset. No global window. Features are written
    before they are ranged, since finding the ranges reads them too."""
    keyed = tables.save(keyed)
    parts = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = ["key", F.xxhash64("wkb"), "wkb", "props"]
    rows = keyed.repartitionByRange(int(parts), "key", F.xxhash64("wkb")).sortWithinPartitions(*order)
    rows = tables.save(rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(counts), "_part").withColumn("feature_id", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "key")


def tile_ranges_of(box: dict[str, Column], z: Column, config: TileConfig) -> dict[str, Column]:
    """Tiles that a box meets at zoom z, with the buffer if the settings say so."""
    x0, x1 = tm.tile_x(box["xmin"], z), tm.tile_x(box["xmax"], z)
    y0, y1 = tm.tile_y(box["ymax"], z), tm.tile_y(box["ymin"], z)
    if config.tile_reach == "buffered_bbox":
        # A tile's buffer in degrees is the same on all sides; so is the box's here.
        by = F.lit(360.0 * config.buffer / config.extent) / tm.grid_size(z)
        x0, x1 = tm.tile_x(box["xmin"] - by, z), tm.tile_x(box["xmax"] + by, z)
        y0, y1 = tm.tile_y(F.least(F.lit(89.9), box["ymax"] + by), z), tm.tile_y(F.greatest(F.lit(-89.9), box["ymin"] - by), z)
    return {"x0": x0, "x1": x1, "y0": y0, "y1": y1}


def work_units(numbered: DataFrame, config: TileConfig, only: tuple[int, int, int] | None = None) -> DataFrame:
    """A row for each feature, zoom and slab of columns (and rows, where a column alone is long): generate, not a join.
    alone: the feature has no other unit at the zoom. With `only`, (z, x, y), units of that tile alone."""
    low, high = (only[0], only[0]) if only else (config.min_zoom, config.max_zoom)
    zooms = numbered.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    box = {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}
    units = zooms.withColumns(tile_ranges_of(box, F.col("z"), config))
    if only:
        _, x, y = only
        units = units.where(F.lit(x).between(F.col("x0"), F.col("x1")) & F.lit(y).between(F.col("y0"), F.col("y1")))
        units = units.withColumns({"x0": F.lit(x).cast("long"), "x1": F.lit(x).cast("long"), "y0": F.lit(y).cast("long"), "y1": F.lit(y).cast("long")})
    high = F.least(F.col("y1") - F.col("y0") + 1, F.lit(UNIT_TILES))
    units = units.withColumn("_high", high).withColumn("_wide", F.greatest(F.lit(1), F.floor(F.lit(UNIT_TILES) / F.col("_high"))))
    units = units.withColumn("alone", (F.col("x1") - F.col("x0") < F.col("_wide")) & (F.col("y1") - F.col("y0") < F.col("_high")))
    units = units.withColumn("ux0", F.explode(F.expr("sequence(x0, x1, _wide)"))).withColumn("uy0", F.explode(F.expr("sequence(y0, y1, _high)")))
    return units.withColumns({"ux1": F.least(F.col("x1"), F.col("ux0") + F.col("_wide") - 1), "uy1": F.least(F.col("y1"), F.col("uy0") + F.col("_high") - 1)}).drop("x0", "x1", "y0", "y1", "_high", "_wide")


PIECES = "tile_id long, z int, x long, y long, feature_id long, kind int, geometry binary, props binary, cx int, cy int"


def _cut(config: TileConfig):
    """For mapInPandas over work units: the clipped, validated, thinned and encoded piece for each tile.

    A unit's columns are cut once and their rows from that; the order of edges is the same as tile by tile. Points that
    meet one tile, which thinning has left by then, are done all at once."""
    density = config.max_per_cell is not None
    grid = config.extent // config.cell_size

    def cell(v: float) -> int:
        return min(int(max(v, 0.0)) // config.cell_size, grid - 1)

    def identified(d: pd.DataFrame) -> pd.DataFrame:
        ids = np.zeros(len(d), np.int64)
        for z in d["z"].unique().tolist():
            m = (d["z"] == z).to_numpy()
            ids[m] = ((1 << 2 * z) - 1) // 3 + curves.hilbert_keys(d["x"].to_numpy()[m].astype(np.uint64), d["y"].to_numpy()[m].astype(np.uint64), z).astype(np.int64)
        d.insert(0, "tile_id", ids)
        return d.astype({"cx": "Int32", "cy": "Int32"})

    def points(b: pd.DataFrame) -> pd.DataFrame:
        tiles, of = np.unique(b[["z", "ux0", "uy0"]].to_numpy(np.int64), axis=0, return_inverse=True)
        boxes = np.array([curves.tile_box(*t) for t in tiles.tolist()]).reshape(-1, 4)
        reach = np.array([kernels.buffered(t, config.buffer, config.extent) for t in boxes.tolist()]).reshape(-1, 4)[of.ravel()].T
        tile, at = boxes[of.ravel()].T, b[["xmin", "ymin"]].to_numpy(float)
        inside = (reach[0] <= at[:, 0]) & (at[:, 0] <= reach[2]) & (reach[1] <= at[:, 1]) & (at[:, 1] <= reach[3])
        b, at, tile = b[inside], at[inside], tile[:, inside]
        raw, sizes = mvt.point_geometries(mvt.pixels(at, tile, config.extent))
        ends = np.cumsum(sizes).tolist()
        out = b[["z", "ux0", "uy0", "feature_id"]].rename(columns={"ux0": "x", "uy0": "y"})
        out = out.assign(kind=mvt.POINTS, geometry=[raw[i:j] for i, j in zip([0, *ends], ends)], props=b["props"], cx=None, cy=None)
        if density:
            cells = np.minimum(np.maximum(kernels.to_pixels(tile, config.extent)(at), 0).astype(np.int64) // config.cell_size, grid - 1)
            base = (b["z"] < config.max_zoom).to_numpy()
            out["cx"], out["cy"] = pd.array(np.where(base, cells[:, 0], 0), "Int32"), pd.array(np.where(base, cells[:, 1], 0), "Int32")
            out.loc[~base, ["cx", "cy"]] = pd.NA
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_wkb, shape, simple = None, None, {}
        for b in batches:
            quick = ((b["kind"] == geom.POINT) & (b["ux0"] == b["ux1"]) & (b["uy0"] == b["uy1"])).to_numpy()
            if quick.any():
                yield identified(points(b[quick]))
                b = b[~quick]
            out: list[tuple] = []
            for u in b.itertuples(index=False):
                if u.wkb is not last_wkb and u.wkb != last_wkb:
                    last_wkb, shape, simple = u.wkb, geom.from_wkb(u.wkb), {}
                at_zoom = config.max_zoom if config.simplify_mode == "max_zoom" else u.z
                if at_zoom not in simple:
                    simple = {at_zoom: kernels.simplify(shape, 360.0 / (1 << at_zoom) / config.extent)}
                g = simple[at_zoom]
                if g.kind in (geom.POINT, geom.MULTIPOINT) and kernels.drops_point(u.z, config.max_zoom, u.feature_id):
                    continue
                own = (u.xmin, u.ymin, u.xmax, u.ymax)
                polygons = g.kind in (geom.POLYGON, geom.MULTIPOLYGON)
                for x in range(u.ux0, u.ux1 + 1):
                    column = g
                    if polygons and u.uy1 > u.uy0:
                        strip = kernels.buffered(curves.tile_box(u.z, x, 0), config.buffer, config.extent)
                        column = kernels.clip(g, (strip[0], -math.inf, strip[2], math.inf))
                        if column is None:
                            continue
                    for y in range(u.uy0, u.uy1 + 1):
                        tile = curves.tile_box(u.z, x, y)
                        reach = kernels.buffered(tile, config.buffer, config.extent)
                        if not kernels.intersects(own, reach):
                            continue
                        piece = kernels.clip(column, reach)
                        piece = piece and kernels.keep_valid(piece)
                        if piece is None or kernels.drops(piece, u.z, config.max_zoom, u.feature_id, tile, config.extent):
                            continue
                        numbers, kind = mvt.commands(piece, tile, config.extent)
                        cx = cy = None
                        if density and u.z < config.max_zoom and (mid := geom.centroid(piece)):
                            p = kernels.to_pixels(tile, config.extent)(np.array([mid]))[0]
                            cx, cy = cell(p[0]), cell(p[1])
                        out.append((u.z, x, y, u.feature_id, kind, mvt.varints(numbers), u.props, cx, cy))
            yield identified(pd.DataFrame(out, columns=["z", "x", "y", "feature_id", "kind", "geometry", "props", "cx", "cy"]))

    return run


def tile_pieces(df: DataFrame, config: TileConfig, tables: Tables | None = None, only: tuple[int, int, int] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(pieces, numbered features, attribute names). pieces: a row for each feature and tile, encoded; see PIECES. With `only`,
    (z, x, y), pieces of that tile alone."""
    tables = tables or Tables(df.sparkSession)
    kinds = field_types(df.schema)
    fields = config.properties.filter_fields(kinds) if config.encode_properties else []
    feats = features(df, config.geometry_column, fields, config.geometry_encoding)
    types = {c: feats.schema[c].dataType.simpleString() for c in fields if c in feats.columns}
    fields = list(types)
    keyed = feats.mapInPandas(_keyed(config, fields, types), "kind int, key long, wkb binary, xmin double, ymin double, xmax double, ymax double, props binary")
    numbered = number_features(keyed, tables)
    # A feature with one unit at a zoom is cut where it lies; the units of larger ones are dealt anew, so that they spread.
    units = work_units(numbered, config, only)
    units = units.where(~F.col("kind").isin(geom.POINT, geom.MULTIPOINT) | keep_point(F.col("feature_id"), F.col("z"), config.max_zoom))
    dealt = units.where("NOT alone").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "feature_id", "z", "ux0", "uy0")
    pieces = units.where("alone").mapInPandas(_cut(config), PIECES).union(dealt.mapInPandas(_cut(config), PIECES))
    if config.max_per_cell is not None:
        w = Window.partitionBy("tile_id", "cx", "cy").orderBy("feature_id")
        pieces = pieces.withColumn("_n", F.row_number().over(w)).where(F.col("cx").isNull() | (F.col("_n") <= config.max_per_cell)).drop("_n")
    return pieces.drop("cx", "cy"), numbered, fields


def encode_tiles(pieces: DataFrame, config: TileConfig, fields: list[str]) -> DataFrame:
    """(tile_id, z, x, y, data, feature_count), a row for each tile, range-partitioned and sorted by tile_id.

    pieces are a written table, since finding the ranges reads them too. They come sorted, and a tile is put together while its pieces pass, across batches; nothing gathers a tile's rows.
    """
    layer, extent = config.layer, config.extent

    def tags(raw: bytes) -> Iterator[tuple[str, bytes]]:
        at = 0
        while at < len(raw):
            i, at = mvt.read_varint(raw, at)
            n, at = mvt.read_varint(raw, at)
            yield fields[i], raw[at : at + n]
            at += n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_layer = None, None
        columns = ["tile_id", "z", "x", "y", "data", "feature_count"]
        for b in batches:
            done = []
            for p in b.itertuples(index=False):
                if now is None or p.tile_id != now[0]:
                    if now is not None and open_layer.count:
                        done.append((*now, open_layer.tile(), open_layer.count))
                    now, open_layer = (p.tile_id, p.z, p.x, p.y), mvt.Layer(layer, extent)
                open_layer.add(p.feature_id, p.kind, p.geometry, tags(p.props))
            yield pd.DataFrame(done, columns=columns)
        if now is not None and open_layer.count:
            yield pd.DataFrame([(*now, open_layer.tile(), open_layer.count)], columns=columns)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(parts, "tile_id").sortWithinPartitions("tile_id", "feature_id")
    return ordered.mapInPandas(run, "tile_id long, z int, x long, y long, data binary, feature_count long")


def generate_tiles(df: DataFrame, config: TileConfig | None = None) -> DataFrame:
    """The tiles of a DataFrame of features, uncompressed: (tile_id, z, x, y, data, feature_count)."""
    config, tables = config or TileConfig(), Tables(df.sparkSession)
    pieces, _, fields = tile_pieces(df, config, tables)
    return encode_tiles(tables.save(pieces), config, fields)


def generate_single_tile(df: DataFrame, z: int, x: int, y: int, config: TileConfig | None = None) -> DataFrame:
    """One tile. All features are numbered, since ids are ranks; only those whose box reaches the tile are cut, for it alone."""
    config = (config or TileConfig()).with_(min_zoom=z, max_zoom=max(z, (config or TileConfig()).max_zoom))
    tables = Tables(df.sparkSession)
    pieces, _, fields = tile_pieces(df, config, tables, (z, x, y))
    return encode_tiles(tables.save(pieces), config, fields)


def dataset_bounds(numbered: DataFrame) -> tuple[float, float, float, float] | None:
    r = numbered.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    return None if r[0] is None else tuple(r)


def directory(tiles: DataFrame, codec: Codec, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(entries, tiles with offsets). entries: (tile_id, run_length, offset, length, data), data compressed where the
    contents come first. Equal contents, by SHA-256, are kept once, at the smallest tile id; only those are compressed."""
    tiles = tables.save(tiles.withColumn("hash", F.sha2("data", 256)))
    first = tiles.groupBy("hash").agg(F.min("tile_id").alias("first_id"))
    unique = tiles.join(first.select(F.col("first_id").alias("tile_id")), "tile_id", "left_semi").select("tile_id", "hash", "data")

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [compress(x, codec) for x in b["data"]]
            yield pd.DataFrame({"first_id": b["tile_id"], "hash": b["hash"], "length": [len(x) for x in data], "data": data})

    unique = tables.save(unique.mapInPandas(squeeze, "first_id long, hash string, length long, data binary"))
    placed = prefix_sums(unique.select("first_id", "hash", "length"), tables)
    rows = tiles.select("tile_id", "z", "feature_count", "hash").join(placed.select("hash", "first_id", "offset", "length"), "hash")
    rows = tables.save(rows)
    runs = tile_runs(rows)
    entries = runs.join(unique.select(F.col("first_id").alias("tile_id"), "data"), "tile_id", "left")
    return entries, rows


def prefix_sums(unique: DataFrame, tables: Tables) -> DataFrame:
    """Adds offset: the lengths of all contents of smaller first_id. In two levels: bins of the id range, then inside."""
    bounds = unique.agg(F.min("first_id"), F.max("first_id"), F.count("*")).first()
    bins = max(1, min(1 << 16, (bounds[2] or 0) // 10_000))
    width = max(1, ((bounds[1] or 0) - (bounds[0] or 0)) // bins + 1)
    rows = unique.withColumn("_bin", F.expr(f"(first_id - {bounds[0] or 0}L) div {width}L"))
    sums = rows.groupBy("_bin").agg(F.sum("length").alias("_sum"))
    over = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    sums = sums.select("_bin", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(F.broadcast(sums), "_bin")
    return rows.withColumn("offset", F.col("_before") + F.col("_in")).drop("_bin", "_in", "_before")


def tile_runs(rows: DataFrame) -> DataFrame:
    """(tile_id, run_length, offset, length): neighbouring tile ids with the same contents as one entry. Runs are told apart
    within each offset, so no window spans all tiles."""
    w = Window.partitionBy("offset").orderBy("tile_id")
    runs = rows.withColumn("_run", F.col("tile_id") - F.row_number().over(w))
    out = runs.groupBy("offset", "length", "_run").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"))
    return out.select("tile_id", "run_length", "offset", "length")


def write_archive(df: DataFrame, path: str, config: TileConfig | None = None, compression: str | Codec = Codec.GZIP, progress=None) -> dict:
    """Tiles a DataFrame of features into a PMTiles archive at a path that driver and executors share. Returns counts:
    features, records, total_tiles, unique_tiles, bytes_written, bytes_saved_dedup, dedup_ratio."""
    import time

    config, codec = config or TileConfig(), Codec.parse(compression)
    compress(b"", codec)  # a missing codec is told before the work
    tell = progress or (lambda event: None)
    began, spark = time.time(), df.sparkSession
    register(spark)
    tables = Tables(spark)
    try:
        tell({"phase": "start", "phase_num": 1, "name": "cut"})
        pieces, numbered, fields = tile_pieces(df, config, tables)
        pieces = tables.save(pieces)
        records = pieces.count()
        tell({"phase": "phase1_progress", "row_group": 1, "total_row_groups": 1, "features_in_group": numbered.count(), "records_written": records})
        tell({"phase": "phase1_complete", "total_records": records, "peak_memory_bytes": 0})
        tell({"phase": "phase2_start"})
        entries, rows = directory(encode_tiles(pieces, config, fields), codec, tables)
        tell({"phase": "phase2_complete"})
        s = rows.agg(F.count("*"), F.sum("feature_count"), F.min("z"), F.max("z"), F.countDistinct("hash"), F.sum("length"), F.sum(F.when(F.col("tile_id") == F.col("first_id"), F.col("length")))).first()
        kinds = field_types(df.schema)
        info = ArchiveInfo(config.layer, {f: kinds[f] for f in config.properties.filter_fields(kinds)}, dataset_bounds(numbered), codec, s[1] or 0, s[2] or 0, s[3] or 0, s[0], s[4])
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = entries.repartitionByRange(parts, "tile_id").sortWithinPartitions("tile_id").select("tile_id", "run_length", "offset", "length", "data")
        out.write.format("pmtiles").option("path", path).option("info", info.to_json()).mode("append").save()
        tell({"phase": "phase3_progress", "tiles_written": s[0], "records_processed": records, "total_records": records})
        took = time.time() - began
        tell({"phase": "complete", "total_tiles": s[0], "peak_memory_bytes": 0, "duration_secs": took})
        saved = (s[5] or 0) - (s[6] or 0)
        return {"features": s[1] or 0, "records": records, "total_tiles": s[0], "unique_tiles": s[4], "bytes_written": s[6] or 0, "bytes_saved_dedup": saved, "dedup_ratio": 1 - s[4] / s[0] if s[0] else 0.0, "seconds": took}
    finally:
        tables.clear()

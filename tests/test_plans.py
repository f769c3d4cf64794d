"""The whole job: features of every kind to tiles, archives, the API, the command line, streams."""

import io
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadmill import cli
from quadmill.api import convert, layer_name
from quadmill.functions import tilemath as tm
from quadmill.operators import curves, geom, mvt
from quadmill.operators.geom import COLLECTION, LINE, MULTIPOINT, POINT, POLYGON, Geometry
from quadmill.operators.pmtiles import Archive
from quadmill.plans import Density, PropertyFilter, TileConfig, generate_single_tile, generate_tiles, write_archive
from quadmill.plans.tables import Tables
from quadmill.plans.tiler import work_units
from quadmill.sources import assess, emit_warnings, features, field_types, geometry_column, read_geoparquet, row_group_count
from quadmill.sources.geoparquet import ReadError
from quadmill.streaming import tile_counts, watch


def square(x, y, s):
    return Geometry(POLYGON, [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)])


def frame(spark, shapes, **columns):
    rows = [(None if g is None else bytearray(geom.to_wkb(g)), i, *(v[i] for v in columns.values())) for i, g in enumerate(shapes)]
    kinds = {str: T.StringType(), float: T.DoubleType(), bool: T.BooleanType(), int: T.LongType()}
    fields = [T.StructField(k, kinds[type(next(x for x in v if x is not None))]) for k, v in columns.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField("geometry", T.BinaryType()), T.StructField("n", T.LongType()), *fields]))


def decoded(tiles):
    return {(r.z, r.x, r.y): mvt.decode(bytes(r.data))[0] for r in tiles.collect()}


def test_points_all_stay_at_the_base_zoom_and_thin_below(spark):
    pts = [Geometry(POINT, np.array([-180 + 0.36 * i, -85 + 0.17 * i])) for i in range(1000)]
    df = frame(spark, pts)
    base = decoded(generate_tiles(df, TileConfig(0, 0)))
    assert len(base[0, 0, 0]["features"]) == 1000
    thin = decoded(generate_tiles(df, TileConfig(0, 2)))
    assert 50 < len(thin[0, 0, 0]["features"]) < 300


def test_small_features_go_and_large_ones_stay(spark):
    shapes = [square(0.0001, 0.0001, 0.0001), square(-10, -10, 20), Geometry(LINE, np.array([[0, 0], [0.01, 0]], float)), Geometry(LINE, np.array([[-90, 0], [90, 0]], float)), Geometry(LINE, np.zeros((1, 2))), Geometry(POLYGON, [np.zeros((5, 2))]), Geometry(MULTIPOINT, np.zeros((0, 2))), None]
    got = decoded(generate_tiles(frame(spark, shapes), TileConfig(0, 0)))[0, 0, 0]["features"]
    assert sorted(f["properties"]["n"] for f in got if f["properties"]["n"] != 0) == [1, 3]


def test_attributes_types_nulls_and_filters(spark):
    df = frame(spark, [square(0, 0, 5), square(1, 1, 5)], name=["a", None], v=[1.5, 2.0], yes=[True, False])
    f = decoded(generate_tiles(df, TileConfig(0, 0)))[0, 0, 0]["features"]
    assert sorted((x["properties"]["n"], x["properties"]) for x in f) == [(0, {"n": 0, "name": "a", "v": 1.5, "yes": True}), (1, {"n": 1, "v": 2.0, "yes": False})]
    only = decoded(generate_tiles(df, TileConfig(0, 0, properties=PropertyFilter.of(include=["v", "other"]))))[0, 0, 0]
    assert {k for x in only["features"] for k in x["properties"]} == {"v"}
    none = decoded(generate_tiles(df, TileConfig(0, 0, encode_properties=False)))[0, 0, 0]
    assert all(not x["properties"] for x in none["features"])
    assert PropertyFilter.of(exclude=["v"]).filter_fields(["v", "n"]) == ["n"] and not PropertyFilter().is_active
    with pytest.raises(ValueError):
        PropertyFilter.of(include=["a"], exclude_all=True)


def test_feature_ids_do_not_depend_on_partitions(spark):
    shapes = [square(i % 9 * 10 - 50, i // 9 * 7 - 40, 3 + i % 4) for i in range(60)]
    df = frame(spark, shapes)
    ids = lambda d: {f["properties"]["n"]: f["id"] for f in decoded(generate_tiles(d, TileConfig(0, 0)))[0, 0, 0]["features"]}
    one, other = ids(df.coalesce(1)), ids(df.repartition(7))
    assert one == other and sorted(one.values()) == list(range(60))
    assert generate_tiles(df, TileConfig(0, 2)).count() == generate_tiles(df.repartition(5), TileConfig(0, 2, curve="zorder")).count()


def test_buffered_reach_adds_the_neighbour(spark):
    edge = curves.tile_box(2, 1, 1)[2]
    df = frame(spark, [Geometry(POINT, np.array([edge - 0.01, 20.0]))])
    near = lambda reach: {(r.x, r.y) for r in generate_tiles(df, TileConfig(2, 2, tile_reach=reach)).select("x", "y").collect()}
    assert near("bbox") == {(1, 1)} and near("buffered_bbox") == {(1, 1), (2, 1)}


def test_density_limit(spark):
    df = frame(spark, [Geometry(POINT, np.array([10 + i / 1000, 10.0])) for i in range(50)])
    n = lambda **k: sum(r.feature_count for r in generate_tiles(df, TileConfig(0, 1, **k)).where("z = 0").collect())
    assert n(max_per_cell=1, cell_size=64) == 1 <= n()
    assert Density.parse("Medium").value == 3 and Density.parse("low").value is None
    with pytest.raises(ValueError):
        Density.parse("extreme")


def test_large_features_are_cut_into_units(spark):
    world = spark.createDataFrame([(-180.0, -85.0, 180.0, 85.0)], "xmin double, ymin double, xmax double, ymax double")
    units = work_units(world, TileConfig(8, 8)).collect()
    assert len(units) > 100 and sum((u.ux1 - u.ux0 + 1) * (u.uy1 - u.uy0 + 1) for u in units) == 1 << 16
    assert max((u.ux1 - u.ux0 + 1) * (u.uy1 - u.uy0 + 1) for u in units) <= 512


def test_single_tile_equals_the_whole_run(spark):
    df = frame(spark, [square(i * 3 - 60, i - 30, 4) for i in range(40)])
    whole = {(r.z, r.x, r.y): bytes(r.data) for r in generate_tiles(df, TileConfig(0, 3)).collect()}
    one = generate_single_tile(df, 2, 1, 2, TileConfig(0, 3)).collect()
    assert [bytes(r.data) for r in one] == [whole[2, 1, 2]]


def test_archive_dedups_counts_and_reads_back(spark, tmp_path):
    t = {z: curves.tile_box(z, 0, 0) for z in (3,)}
    w = t[3][2] - t[3][0]
    # the same picture in tiles of one row, whose boxes are alike but for their place
    shapes = [Geometry(COLLECTION, [])] + [square(-180 + w * (i + 0.25), 10, w / 2) for i in range(8)]
    path = str(tmp_path / "d.pmtiles")
    df = frame(spark, shapes).drop("n")
    r = write_archive(df, path, TileConfig(3, 3, layer="l", encode_properties=False), "none")
    a = Archive(path)
    assert r["total_tiles"] == a.header.addressed == sum(e.run for e in a.entries()) == spark.read.format("pmtiles").load(path).count()
    assert a.header.contents == r["unique_tiles"] and (a.header.min_zoom, a.header.max_zoom) == (3, 3)
    whole = {x.tile_id: bytes(x.data) for x in generate_tiles(df, TileConfig(3, 3, layer="l", encode_properties=False)).collect()}
    assert {x.tile_id: bytes(x.data) for x in spark.read.format("pmtiles").load(path).collect()} == whole


def test_equal_tiles_are_stored_once_in_runs(spark, tmp_path):
    from quadmill.operators.pmtiles import Codec
    from quadmill.plans.tiler import directory

    tiles = spark.createDataFrame([(i, 3, 0, i, bytearray(b"A" if i in (1, 2, 3, 9) else b"B%d" % i), 1) for i in range(1, 12)], "tile_id long, z int, x long, y long, data binary, feature_count int")
    entries, _ = directory(tiles, Codec.NONE, Tables(spark))
    got = sorted((e.tile_id, e.run_length, e.offset, e.length, e.data and bytes(e.data)) for e in entries.collect())
    assert got[0] == (1, 3, 0, 1, b"A") and (9, 1, 0, 1, None) in got and sum(g[1] for g in got) == 11
    assert [g[4] for g in got if g[4]] == [b"A"] + [b"B%d" % i for i in (4, 5, 6, 7, 8, 10, 11)]


def test_empty_input_gives_a_valid_archive(spark, tmp_path):
    path = str(tmp_path / "e.pmtiles")
    r = write_archive(frame(spark, [Geometry(MULTIPOINT, np.zeros((0, 2)))]), path, TileConfig(0, 3))
    a = Archive(path)
    assert r["total_tiles"] == 0 and list(a.entries()) == [] and a.header.bounds[0] == -180 and "tilestats" not in a.metadata()


@pytest.fixture()
def parquet(tmp_path):
    shapes = [square(i, i / 2, 3) for i in range(30)] + [None]
    t = pa.table({"id": list(range(31)), "name": ["x"] * 31, "geometry": pa.array([None if g is None else geom.to_wkb(g) for g in shapes], pa.binary()), "tags": [["a"]] * 31})
    path = str(tmp_path / "places.parquet")
    pq.write_table(t.replace_schema_metadata({"geo": '{"bbox": []}'}), path, row_group_size=10)
    return path


def test_convert_and_events(spark, parquet, tmp_path):
    events = []
    out = str(tmp_path / "o.pmtiles")
    r = convert(parquet, out, 0, 3, "high", "zstd", exclude=["id"], progress_callback=events.append, spark=spark)
    a = Archive(out)
    assert a.metadata()["vector_layers"] == [{"id": "places", "minzoom": 0, "maxzoom": 3, "fields": {"name": "String"}}]
    assert [e["phase"] for e in events] == ["start", "phase1_progress", "phase1_complete", "phase2_start", "phase2_complete", "phase3_progress", "complete"]
    assert events[-1]["total_tiles"] == r["total_tiles"] > 0
    assert layer_name("/a/b.parquet") == "b" and layer_name("", None) == "layer"


def test_convert_errors(spark, parquet, tmp_path):
    out = str(tmp_path / "o.pmtiles")
    with pytest.raises(TypeError):
        convert(parquet, out, progress_callback=3, spark=spark)
    for bad in ({"drop_density": "x"}, {"compression": "x"}, {"include": ["a"], "exclude": ["b"]}, {"min_zoom": 5, "max_zoom": 2}):
        with pytest.raises(ValueError):
            convert(parquet, out, spark=spark, **bad)
    with pytest.raises(RuntimeError):
        convert(str(tmp_path / "missing.parquet"), out, spark=spark)

    def broken(event):
        raise KeyError("shown, not raised")

    assert convert(parquet, out, 0, 1, progress_callback=broken, spark=spark)["total_tiles"] > 0


def test_command_line(spark, parquet, tmp_path, capsys):
    out = str(tmp_path / "c.pmtiles")
    assert cli.main([parquet, out, "--max-zoom", "2", "-y", "name", "-v", "--layer-name", "mine"]) == 0
    assert "tiles" in capsys.readouterr().out and Archive(out).metadata()["vector_layers"][0]["id"] == "mine"
    assert cli.main([parquet, out, "-X", "-y", "name"]) == 1


def test_schema_rules(spark, parquet):
    df = read_geoparquet(spark, parquet)
    assert geometry_column(["a", "the_geom", "geometry"]) == "the_geom"
    assert field_types(df.schema) == {"id": "Number", "name": "String"}
    assert field_types(T.StructType([T.StructField("u", T.DecimalType(20, 0)), T.StructField("d", T.DecimalType(9, 2)), T.StructField("b", T.BooleanType())])) == {"u": "Number", "b": "Boolean"}
    with pytest.raises(ReadError):
        geometry_column(["a"])
    assert features(df).count() == 30 and features(df).columns == ["wkb", "id", "name"]
    plan = features(df, keep=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "tags" not in plan and "name" not in plan


def test_native_encodings(spark):
    point = "struct<x double, y double>".replace(" double", ":double")
    rows = {point: {"x": 1.0, "y": 2.0}, f"array<{point}>": [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}], f"array<array<{point}>>": [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]}
    for kind, value in rows.items():
        df = spark.createDataFrame([(value,), (None,)], T.StructType([T.StructField("geometry", T._parse_datatype_string(kind))]))
        got = [geom.from_wkb(bytes(r.wkb)) for r in features(df).collect()]
        assert [g.kind for g in got] == [{0: POINT, 1: LINE, 2: POLYGON}[kind.count("array")]]
    many = spark.createDataFrame([(rows[f"array<{point}>"],)], T.StructType([T.StructField("geometry", T._parse_datatype_string(f"array<{point}>"))]))
    assert geom.from_wkb(bytes(features(many, encoding="multipoint").first().wkb)).kind == MULTIPOINT
    with pytest.raises(ReadError):
        features(spark.createDataFrame([("POINT(0 0)",)], "geometry string"))


def test_quality(parquet, tmp_path):
    q = assess(parquet)
    assert (q.has_geo_metadata, q.has_row_group_bboxes, q.row_group_count, q.total_rows, q.avg_rows_per_group) == (True, True, 4, 31, 7)
    assert not q.is_optimized and len(q.suggestions()) == 1 and row_group_count(parquet) == 4
    to = io.StringIO()
    emit_warnings(q, to=to)
    emit_warnings(q, quiet=True, to=to)
    assert to.getvalue().count("Row groups hold") == 1
    bare = str(tmp_path / "bare.parquet")
    pq.write_table(pa.table({"geometry": [b""]}), bare)
    assert assess(bare).suggestions() == ["The file has no GeoParquet metadata"]


def test_config_is_checked():
    for bad in ({"min_zoom": 3, "max_zoom": 1}, {"curve": "x"}, {"cell_size": 0}, {"max_per_cell": 0}, {"max_zoom": 31}):
        with pytest.raises(ValueError):
            TileConfig(**bad)


def test_stream_of_files(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), {}
    df = frame(spark, [square(i * 5 - 40, 0, 4) for i in range(10)])
    df.write.parquet(folder)
    q = watch(spark, folder, df.schema, TileConfig(0, 1), lambda tiles, batch: seen.update({batch: tiles.count()}), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen.values()) == generate_tiles(df, TileConfig(0, 1)).count()


def test_streamed_tile_counts_equal_the_batch(spark, tmp_path):
    pts = spark.range(500).select(((F.col("id") * 7 % 360) - 180.0).alias("lng"), ((F.col("id") * 3 % 160) - 80.0).alias("lat"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    pts.write.parquet(str(tmp_path / "p"))
    batch = tile_counts(spark.read.parquet(str(tmp_path / "p")), 2, "ts", "1 hour", "10 minutes")
    stream = tile_counts(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "p")), 2, "ts", "1 hour", "10 minutes")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_tile_math_columns(spark):
    r = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0)], "z int, x long, y long")
    assert [x[0] for x in r.select(tm.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()] == list(range(6))
    one = spark.range(1).select(tm.tile_x(F.lit(180.0), 4), tm.tile_y(F.lit(-90.0), 4), tm.tile_y(F.lit(90.0), 4), tm.unzigzag(tm.zigzag(F.lit(-7))), tm.command(7, 1)).first()
    assert tuple(one) == (15, 15, 0, -7, 15)
    b = spark.range(1).select(tm.tile_bounds(0, F.lit(0), F.lit(0)).alias("b")).select(tm.box_valid(F.col("b")), tm.box_valid(tm.box_buffer(F.col("b"), F.lit(-500.0)))).first()
    assert tuple(b) == (True, False)


def test_bad_wkb_is_told(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<BI", 1, 77)),)], "geometry binary")
    with pytest.raises(Exception, match="unknown WKB type"):
        generate_tiles(df, TileConfig(0, 0)).collect()

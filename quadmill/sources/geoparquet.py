"""GeoParquet as DataFrames: finding the geometry column, native encodings to WKB, field types."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import geom
from ..operators.geom import Geometry


class ReadError(RuntimeError):
    """Input that cannot be read as features."""


def is_geometry_name(name: str) -> bool:
    return name == "geometry" or "geom" in name


def geometry_column(names: list[str]) -> str:
    """The first column that is called geometry or has geom in its name."""
    for name in names:
        if is_geometry_name(name):
            return name
    raise ReadError("No geometry column found")


def field_types(schema: T.StructType) -> dict[str, str]:
    """Attribute columns as String, Number or Boolean; other types and geometry-like columns are left out."""
    out = {}
    for f in schema.fields:
        if is_geometry_name(f.name):
            continue
        if isinstance(f.dataType, T.StringType):
            out[f.name] = "String"
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = "Boolean"
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)) or f.dataType == T.DecimalType(20, 0):
            out[f.name] = "Number"  # unsigned 64-bit columns arrive as decimal(20,0)
    return out


def _depth(t: T.DataType) -> tuple[int, T.DataType]:
    n = 0
    while isinstance(t, T.ArrayType):
        n, t = n + 1, t.elementType
    return n, t


def _native(value, depth: int, kinds: tuple[int, ...]) -> Geometry:
    def xy(points) -> np.ndarray:
        return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)

    kind = kinds[0]
    if depth == 0:
        return Geometry(geom.POINT, np.array([value["x"], value["y"]], float))
    if depth == 1:
        return Geometry(kind, xy(value))
    if depth == 2:
        return Geometry(kind, [xy(r) for r in value])
    return Geometry(kind, [[xy(r) for r in p] for p in value])


_KINDS = {0: geom.POINT, 1: geom.LINE, 2: geom.POLYGON, 3: geom.MULTIPOLYGON}


def to_wkb_column(df: DataFrame, column: str, encoding: str | None = None) -> DataFrame:
    """df with the column as WKB. Binary columns stay. Nested lists of struct(x, y) are native encodings: point,
    linestring, polygon, multipolygon by depth, or multipoint and multilinestring where `encoding` says so."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BinaryType):
        return df
    depth, leaf = _depth(kind)
    if not (isinstance(leaf, T.StructType) and {"x", "y"} <= set(leaf.names) and depth <= 3):
        raise ReadError(f"Unsupported geometry encoding: {kind.simpleString()}")
    code = {"multipoint": geom.MULTIPOINT, "multilinestring": geom.MULTILINE}.get((encoding or "").lower(), _KINDS[depth])
    names = df.columns
    at = names.index(column)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema.fields])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wkb = [None if v is None else geom.to_wkb(_native(v, depth, (code,))) for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(wkb, pa.binary()) if i == at else b.column(i) for i in range(b.num_columns)], names=names)

    return df.mapInArrow(convert, schema)


def read_geoparquet(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The file or folder as a DataFrame. With bbox, and a covering column bbox struct(xmin, ymin, xmax, ymax), the box is a
    filter that reaches the Parquet row groups."""
    df = spark.read.parquet(path)
    if bbox is not None and "bbox" in df.columns:
        b = F.col("bbox")
        df = df.where((b["xmin"] <= bbox[2]) & (b["xmax"] >= bbox[0]) & (b["ymin"] <= bbox[3]) & (b["ymax"] >= bbox[1]))
    return df


def features(df: DataFrame, geometry: str | None = None, keep: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """(wkb, attributes): the geometry column as WKB and the attribute columns of a field type, `keep` of them if given.
    Rows without geometry are left out. The selection is the scan's read schema."""
    name = geometry or geometry_column(df.columns)
    fields = [c for c in field_types(df.schema) if keep is None or c in keep]
    out = to_wkb_column(df.select(F.col(f"`{name}`"), *[F.col(f"`{c}`") for c in fields if c != name]), name, encoding)
    return out.withColumnRenamed(name, "wkb").where("wkb IS NOT NULL")


def row_group_count(path: str) -> int:
    import pyarrow.parquet as pq

    return pq.ParquetFile(path).metadata.num_row_groups

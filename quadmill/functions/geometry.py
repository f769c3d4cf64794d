"""Geometry kernels as Arrow-batched functions of WKB columns; register() makes them known to SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import geom, kernels, mvt
from ..operators.geom import Geometry

_BOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("xmin", "ymin", "xmax", "ymax")])
_POINT = T.StructType([T.StructField(k, T.DoubleType()) for k in ("lng", "lat")])


def _each(f, *columns: pd.Series) -> list:
    return [None if any(v is None for v in row) else f(geom.from_wkb(row[0]), *row[1:]) for row in zip(*columns)]


def _wkb(g: Geometry | None) -> bytes | None:
    return None if g is None else geom.to_wkb(g)


@F.pandas_udf(_BOX)
def wkb_bbox(wkb: pd.Series) -> pd.DataFrame:
    """struct(xmin, ymin, xmax, ymax); nulls for empty geometries."""
    return pd.DataFrame([b or (None,) * 4 for b in _each(geom.bbox, wkb)], columns=_BOX.names, dtype="float64")


@F.pandas_udf(_POINT)
def wkb_centroid(wkb: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([c or (None, None) for c in _each(geom.centroid, wkb)], columns=_POINT.names, dtype="float64")


@F.pandas_udf(T.StringType())
def wkb_type(wkb: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda g: geom.NAMES[g.kind], wkb), dtype=object)


@F.pandas_udf(T.DoubleType())
def wkb_area(wkb: pd.Series) -> pd.Series:
    """Square degrees of polygons and multipolygons, else 0."""
    area = lambda g: geom.polygon_area(g.data) if g.kind == geom.POLYGON else sum(map(geom.polygon_area, g.data)) if g.kind == geom.MULTIPOLYGON else 0.0
    return pd.Series(_each(area, wkb), dtype="float64")


@F.pandas_udf(T.BinaryType())
def wkb_simplify(wkb: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda g, t: _wkb(kernels.simplify(g, t)), wkb, tolerance), dtype=object)


@F.pandas_udf(T.BinaryType())
def wkb_clip(wkb: pd.Series, xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """The part in the box; null for none."""
    return pd.Series(_each(lambda g, *box: _wkb(kernels.clip(g, box)), wkb, xmin, ymin, xmax, ymax), dtype=object)


@F.pandas_udf(T.BinaryType())
def wkb_valid_part(wkb: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda g: _wkb(kernels.keep_valid(g)), wkb), dtype=object)


@F.pandas_udf(T.StringType())
def wkb_why_invalid(wkb: pd.Series) -> pd.Series:
    return pd.Series(_each(lambda g: (why := kernels.why_invalid(g)) and why.reason, wkb), dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def wkb_mvt_commands(wkb: pd.Series, xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """Command integers in the tile with that box, extent 4096."""
    return pd.Series(_each(lambda g, *box: mvt.commands(g, box)[0].tolist(), wkb, xmin, ymin, xmax, ymax), dtype=object)


ALL = (wkb_bbox, wkb_centroid, wkb_type, wkb_area, wkb_simplify, wkb_clip, wkb_valid_part, wkb_why_invalid, wkb_mvt_commands)


def register(spark: SparkSession) -> None:
    for f in ALL:
        spark.udf.register(f.__name__, f)

"""Is an input file well laid out? Footer facts, and for large files how well rows follow the Hilbert curve."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import curves, geom
from .geoparquet import geometry_column

#: Fixed values of the diagnosis.
MIN_ROWS_PER_GROUP = 100
LARGE_MB, FEW_GROUPS = 500, 5
SAMPLED_BYTES = 1 << 30
SAMPLE_ROWS, MIN_SAMPLES, MAX_INVERSIONS = 1000, 10, 0.05
MAX_OVERLAP = 0.2


@dataclass(frozen=True)
class Quality:
    has_geo_metadata: bool
    has_row_group_bboxes: bool
    row_group_count: int
    total_rows: int
    avg_rows_per_group: int
    file_size_bytes: int
    row_group_overlap_pct: float | None = None
    is_hilbert_sorted: bool | None = None

    @property
    def is_optimized(self) -> bool:
        return self.has_geo_metadata and (self.row_group_count <= 1 or self.has_row_group_bboxes) and self.is_hilbert_sorted is not False and self.avg_rows_per_group >= MIN_ROWS_PER_GROUP

    def suggestions(self) -> list[str]:
        out = []
        if not self.has_geo_metadata:
            out.append("The file has no GeoParquet metadata")
        if self.row_group_count > 1 and not self.has_row_group_bboxes:
            out.append("Row groups have no bounding boxes, so none can be skipped by place")
        if self.row_group_count > 1 and self.avg_rows_per_group < MIN_ROWS_PER_GROUP:
            out.append(f"Row groups hold {self.avg_rows_per_group} rows each; {MIN_ROWS_PER_GROUP} or more are wanted")
        if self.file_size_bytes >> 20 > LARGE_MB and self.row_group_count < FEW_GROUPS:
            out.append(f"{self.file_size_bytes >> 20} MB in only {self.row_group_count} row groups")
        if self.row_group_overlap_pct is not None and self.row_group_overlap_pct > MAX_OVERLAP:
            out.append(f"Row groups overlap by {self.row_group_overlap_pct:.0%}")
        if self.is_hilbert_sorted is False:
            out.append("Rows do not follow a Hilbert curve")
        return out


def inversion_rate(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row, inversion_rate: rows with a smaller key than the row before them, of all rows. For samples: the order is
    one window."""
    before = F.lag(key).over(Window.orderBy(order))
    return df.select(F.when(F.col(key) < before, 1).otherwise(0).alias("down")).agg((F.sum("down") / F.count("*")).alias("inversion_rate"))


def _looks_sorted(path: str) -> bool:
    """From the first rows, points and polygons only; true where there is too little to tell."""
    import pyarrow.parquet as pq

    f = pq.ParquetFile(path)
    name = geometry_column(f.schema_arrow.names)
    batch = next(f.iter_batches(SAMPLE_ROWS, columns=[name]), None)
    if batch is None:
        return True
    shapes = [geom.from_wkb(v) for v in batch.column(0).to_pylist() if isinstance(v, bytes)]
    if any(g.kind not in (geom.POINT, geom.POLYGON) for g in shapes):
        return True
    centers = np.array([c for g in shapes if (c := geom.centroid(g))], float).reshape(-1, 2)
    if len(centers) < MIN_SAMPLES:
        return True
    keys = curves.hilbert_keys(*curves.world(centers[:, 0], centers[:, 1]))
    return bool((keys[1:] < keys[:-1]).sum() / len(keys) < MAX_INVERSIONS)


def assess(path: str) -> Quality:
    """The facts of one file's footer, read on the driver."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    pairs = {k.decode().lower(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items()}
    groups, rows, size = meta.num_row_groups, meta.num_rows, os.path.getsize(path)
    covered = groups <= 1 or any(w in pairs.get("geo", "") for w in ("covering", "bbox"))
    return Quality(any("geo" in k for k in pairs), covered, groups, rows, rows // groups if groups else 0, size, None, _looks_sorted(path) if size > SAMPLED_BYTES else None)


def emit_warnings(q: Quality, quiet: bool = False, to=None) -> None:
    if quiet or not q.suggestions():
        return
    print("Input file is not laid out for tiling:", *(f"  - {s}" for s in q.suggestions()), sep="\n", file=to or sys.stderr)

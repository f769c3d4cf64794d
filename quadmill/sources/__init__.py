"""Readers and sinks: GeoParquet in, PMTiles in and out, input diagnosis."""

from .geoparquet import features, field_types, geometry_column, read_geoparquet, row_group_count  # noqa: F401
from .pmtiles import PMTilesSource, register  # noqa: F401
from .quality import Quality, assess, emit_warnings, inversion_rate  # noqa: F401

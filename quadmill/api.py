"""convert(): a GeoParquet file to a PMTiles archive."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from .operators.pmtiles import Codec
from .plans.config import Density, PropertyFilter, TileConfig
from .plans.tiler import write_archive
from .sources.geoparquet import read_geoparquet
from .sources.quality import assess, emit_warnings


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("quadmill").getOrCreate()


def layer_name(path: str, name: str | None = None) -> str:
    return name or PurePosixPath(path).stem or "layer"


def convert(
    input: str,
    output: str,
    min_zoom: int = 0,
    max_zoom: int = 14,
    drop_density: str = "medium",
    compression: str = "gzip",
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    exclude_all: bool = False,
    layer_name: str | None = None,
    deterministic: bool = False,
    progress_callback: Callable[[dict], None] | None = None,
    apply_density: bool = False,
    spark: SparkSession | None = None,
) -> dict:
    """Tiles the features of `input` into `output` and returns the run's counts.

    drop_density is checked; it takes effect with apply_density, as plain conversions keep all that the zoom rules keep.
    Output is deterministic with or without `deterministic`. TypeError for a callback that can't be called, ValueError for
    wrong options, RuntimeError for what fails on the way. A callback's exceptions are shown and passed over.
    """
    if progress_callback is not None and not callable(progress_callback):
        raise TypeError("progress_callback must be callable")
    properties = PropertyFilter.of(include, exclude, exclude_all)
    density = Density.parse(drop_density)
    codec = Codec.parse(compression)
    name = layer_name or PurePosixPath(input).stem or "layer"
    config = TileConfig(min_zoom, max_zoom, layer=name, properties=properties, max_per_cell=density.value if apply_density else None)

    def tell(event: dict) -> None:
        try:
            progress_callback(event)
        except Exception as e:
            print(f"progress_callback: {e!r}")

    spark = spark or session()
    try:
        try:
            emit_warnings(assess(input))
        except (OSError, ValueError):
            pass  # the diagnosis is of single local files; others are read all the same
        return write_archive(read_geoparquet(spark, input), output, config, codec, tell if progress_callback else None)
    except ValueError:
        raise
    except Exception as e:
        raise RuntimeError(f"conversion failed: {e}") from e

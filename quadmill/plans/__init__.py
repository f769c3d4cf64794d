"""Whole jobs as DataFrame plans."""

from .config import Density, PropertyFilter, TileConfig  # noqa: F401
from .tiler import dataset_bounds, encode_tiles, generate_single_tile, generate_tiles, tile_pieces, write_archive  # noqa: F401

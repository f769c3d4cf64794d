"""Arriving files: tiles kept up to date by micro-batches."""

from .incremental import tile_counts, watch  # noqa: F401

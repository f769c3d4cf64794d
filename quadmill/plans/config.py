"""Settings of a tiling job."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum


@dataclass(frozen=True)
class PropertyFilter:
    """Which attributes go into tiles. The geometry always does; names that no column has are passed over."""

    mode: str = "all"
    names: frozenset[str] = frozenset()

    @classmethod
    def of(cls, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None, exclude_all: bool = False) -> "PropertyFilter":
        include, exclude = list(include or ()), list(exclude or ())
        if bool(include) + bool(exclude) + exclude_all > 1:
            raise ValueError("Cannot combine include, exclude, and exclude_all. Use only one property filter option.")
        if exclude_all:
            return cls("none")
        return cls("include", frozenset(include)) if include else cls("exclude", frozenset(exclude)) if exclude else cls()

    @property
    def is_active(self) -> bool:
        return self.mode != "all"

    def keeps(self, name: str) -> bool:
        return {"all": True, "none": False, "include": name in self.names, "exclude": name not in self.names}[self.mode]

    def filter_fields(self, names: Iterable[str]) -> list[str]:
        return [n for n in names if self.keeps(n)]


class Density(Enum):
    """Named density settings as features per grid cell; low turns the limit off."""

    LOW, MEDIUM, HIGH = None, 3, 1

    @classmethod
    def parse(cls, name: str) -> "Density":
        try:
            return cls[name.upper()]
        except KeyError:
            raise ValueError(f"Invalid drop density: '{name}'. Valid options: low, medium, high") from None


@dataclass(frozen=True)
class TileConfig:
    """simplify_mode: max_zoom simplifies once for all zooms, per_zoom for each. tile_reach: bbox puts a feature into the
    tiles that its box meets, buffered_bbox also into those that only see it in their buffer. max_per_cell: None for no
    density limit. curve: hilbert or zorder, the order that numbers features."""

    min_zoom: int = 0
    max_zoom: int = 14
    extent: int = 4096
    buffer: int = 8
    layer: str = "layer"
    max_per_cell: int | None = None
    cell_size: int = 16
    curve: str = "hilbert"
    properties: PropertyFilter = PropertyFilter()
    encode_properties: bool = True
    simplify_mode: str = "max_zoom"
    tile_reach: str = "bbox"
    deterministic: bool = True  # always so: every order has a full key
    memory_budget: int | None = None  # advisory; executors' memory settings rule
    quiet: bool = False
    geometry_column: str | None = None
    geometry_encoding: str | None = None

    def __post_init__(self):
        if not 0 <= self.min_zoom <= self.max_zoom <= 30:
            raise ValueError(f"zooms must be 0 <= min_zoom <= max_zoom <= 30, not {self.min_zoom} and {self.max_zoom}")
        for name, allowed in (("curve", ("hilbert", "zorder")), ("simplify_mode", ("max_zoom", "per_zoom")), ("tile_reach", ("bbox", "buffered_bbox"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.extent < 1 or self.buffer < 0 or not 1 <= self.cell_size <= self.extent or (self.max_per_cell is not None and self.max_per_cell < 1):
            raise ValueError("extent, cell_size and max_per_cell must be at least 1, cell_size at most the extent, buffer at least 0")

    def with_(self, **changes) -> "TileConfig":
        return replace(self, **changes)

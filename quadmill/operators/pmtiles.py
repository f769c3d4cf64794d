"""PMTiles v3: header, directories with leaves, compression, and reading. The public specification's layout."""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from enum import IntEnum
from typing import NamedTuple

from .mvt import read_varint, varint

HEADER_BYTES = 127
#: The root directory must end within the first 16 KiB.
ROOT_BYTES = 16384 - HEADER_BYTES
LEAF_ENTRIES = 4096


class Codec(IntEnum):
    UNKNOWN, NONE, GZIP, BROTLI, ZSTD = range(5)

    @classmethod
    def parse(cls, name: "str | Codec") -> "Codec":
        if isinstance(name, Codec):
            return name
        try:
            return {"none": cls.NONE, "gzip": cls.GZIP, "brotli": cls.BROTLI, "zstd": cls.ZSTD}[name.lower()]
        except KeyError:
            raise ValueError(f"Invalid compression: '{name}'. Valid options: none, gzip, brotli, zstd") from None


class TileType(IntEnum):
    UNKNOWN, MVT, PNG, JPEG, WEBP, AVIF = range(6)


def compress(raw: bytes, codec: Codec) -> bytes:
    if codec == Codec.NONE:
        return raw
    if codec == Codec.GZIP:
        return gzip.compress(raw, 6, mtime=0)
    if codec == Codec.ZSTD:
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(raw)
    if codec == Codec.BROTLI:
        return _brotli().compress(raw, quality=4)
    raise ValueError("no compression of that code")


def decompress(raw: bytes, codec: Codec) -> bytes:
    if codec == Codec.NONE:
        return raw
    if codec == Codec.GZIP:
        return zlib.decompress(raw, 31)
    if codec == Codec.ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if codec == Codec.BROTLI:
        return _brotli().decompress(raw)
    raise ValueError("no compression of that code")


def _brotli():
    try:
        import brotli
    except ImportError as e:
        raise ValueError("brotli needs the module of that name; use gzip, zstd or none") from e
    return brotli


class Entry(NamedTuple):
    """run: tiles in a row with these contents; 0 for a leaf directory."""

    tile_id: int
    offset: int
    length: int
    run: int


def write_directory(entries: Iterable[Entry]) -> bytes:
    entries = list(entries)
    out = bytearray(varint(len(entries)))
    last = 0
    for e in entries:
        out += varint(e.tile_id - last)
        last = e.tile_id
    for e in entries:
        out += varint(e.run)
    for e in entries:
        out += varint(e.length)
    following = None
    for e in entries:
        out += varint(0 if e.offset == following else e.offset + 1)
        following = e.offset + e.length
    return bytes(out)


def read_directory(raw: bytes) -> list[Entry]:
    n, at = read_varint(raw, 0)
    columns: list[list[int]] = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = read_varint(raw, at)
            column.append(v)
        columns.append(column)
    out: list[Entry] = []
    tile = 0
    for delta, run, length, offset in zip(*columns):
        tile += delta
        out.append(Entry(tile, offset - 1 if offset else out[-1].offset + out[-1].length, length, run))
    return out


@dataclass
class Header:
    root_offset: int = HEADER_BYTES
    root_length: int = 0
    metadata_offset: int = 0
    metadata_length: int = 0
    leaves_offset: int = 0
    leaves_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    addressed: int = 0
    entries: int = 0
    contents: int = 0
    clustered: bool = True
    internal_codec: Codec = Codec.GZIP
    tile_codec: Codec = Codec.GZIP
    tile_type: TileType = TileType.MVT
    min_zoom: int = 0
    max_zoom: int = 0
    bounds: tuple[float, float, float, float] = (-180.0, -85.0511287798066, 180.0, 85.0511287798066)

    def pack(self) -> bytes:
        e7 = lambda v: int(v * 1e7)
        b = self.bounds
        numbers = (self.root_offset, self.root_length, self.metadata_offset, self.metadata_length, self.leaves_offset, self.leaves_length, self.data_offset, self.data_length, self.addressed, self.entries, self.contents)
        center = ((self.min_zoom + self.max_zoom) // 2, e7((b[0] + b[2]) / 2), e7((b[1] + b[3]) / 2))
        return struct.pack("<7sB11Q6B4iB2i", b"PMTiles", 3, *numbers, self.clustered, self.internal_codec, self.tile_codec, self.tile_type, self.min_zoom, self.max_zoom, *map(e7, b), *center)

    @classmethod
    def unpack(cls, raw: bytes) -> "Header":
        if len(raw) < HEADER_BYTES or raw[:8] != b"PMTiles\x03":
            raise ValueError("not a PMTiles v3 archive")
        v = struct.unpack("<7sB11Q6B4iB2i", raw[:HEADER_BYTES])[2:]
        return cls(*v[:11], bool(v[11]), Codec(v[12]), Codec(v[13]), TileType(v[14]), v[15], v[16], tuple(x / 1e7 for x in v[17:21]))


@dataclass
class ArchiveInfo:
    """What the archive says about itself besides its tiles."""

    layer: str = "layer"
    fields: dict[str, str] = field(default_factory=dict)
    bounds: tuple[float, float, float, float] | None = None
    tile_codec: int = Codec.GZIP
    features: int = 0
    min_zoom: int = 0
    max_zoom: int = 0
    addressed: int = 0
    contents: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "ArchiveInfo":
        got = json.loads(text)
        return cls(**got | {"bounds": tuple(got["bounds"]) if got.get("bounds") else None})

    def metadata(self) -> bytes:
        out: dict = {"vector_layers": [{"id": self.layer, "minzoom": self.min_zoom, "maxzoom": self.max_zoom, "fields": dict(sorted(self.fields.items()))}]}
        if self.features:
            out["tilestats"] = {"layerCount": 1, "layers": [{"layer": self.layer, "count": self.features, "attributeCount": len(self.fields)}]}
        return json.dumps(out | {"format": "pbf", "generator": "quadmill"}, separators=(",", ":"), ensure_ascii=False).encode()


def assemble(path: str, entries: Iterator[Entry], data_parts: list[str], info: ArchiveInfo) -> Header:
    """Writes an archive from entries in tile order and the files that hold the tile data in that order.

    Entries go by leaves, so no more than one leaf's are held at once. The file appears under its name when it is
    whole. Without tiles it is a valid archive whose bounds are the world."""
    codec = Codec(info.tile_codec)
    own = f"{path}.{os.getpid()}.tmp"
    leaves_path = own + ".leaves"
    heads: list[Entry] = []
    n, at = 0, 0
    block: list[Entry] = []
    first: list[Entry] | None = None
    with open(leaves_path, "wb") as leaves:

        def flush() -> None:
            nonlocal at
            raw = compress(write_directory(block), codec)
            leaves.write(raw)
            heads.append(Entry(block[0].tile_id, at, len(raw), 0))
            at += len(raw)

        for e in entries:
            block.append(e)
            n += 1
            if len(block) == LEAF_ENTRIES:
                flush()
                block = []
        if not heads:
            first = block
        elif block:
            flush()
    root = compress(write_directory(first if first is not None else heads), codec)
    if first is not None and len(root) > ROOT_BYTES:
        with open(leaves_path, "wb") as leaves:
            step, at, heads = 512, 0, []
            for i in range(0, len(first), step):
                raw = compress(write_directory(first[i : i + step]), codec)
                leaves.write(raw)
                heads.append(Entry(first[i].tile_id, at, len(raw), 0))
                at += len(raw)
        root, first = compress(write_directory(heads), codec), None
    # A root of too many leaves is folded: leaves of leaves.
    with open(leaves_path, "ab") as leaves:
        while len(root) > ROOT_BYTES:
            upper = []
            for i in range(0, len(heads), LEAF_ENTRIES):
                raw = compress(write_directory(heads[i : i + LEAF_ENTRIES]), codec)
                leaves.write(raw)
                upper.append(Entry(heads[i].tile_id, at, len(raw), 0))
                at += len(raw)
            heads, root = upper, compress(write_directory(upper), codec)
    meta = compress(info.metadata(), codec)
    h = Header(root_length=len(root), metadata_offset=HEADER_BYTES + len(root), metadata_length=len(meta), internal_codec=codec, tile_codec=codec)
    h.leaves_offset, h.leaves_length = h.metadata_offset + len(meta), at if first is None else 0
    h.data_offset = h.leaves_offset + h.leaves_length
    h.data_length = sum(os.path.getsize(p) for p in data_parts)
    h.addressed, h.entries, h.contents = info.addressed, n, info.contents
    h.min_zoom, h.max_zoom = info.min_zoom, info.max_zoom
    if info.bounds:
        h.bounds = tuple(info.bounds)
    with open(own, "wb") as out:
        out.write(h.pack() + root + meta)
        for p in ([leaves_path] if h.leaves_length else []) + data_parts:
            with open(p, "rb") as part:
                while chunk := part.read(1 << 22):
                    out.write(chunk)
    os.remove(leaves_path)
    os.replace(own, path)
    return h


class Archive:
    """Reads an archive from a file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.header = Header.unpack(f.read(HEADER_BYTES))

    def _bytes(self, offset: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(length)

    def metadata(self) -> dict:
        h = self.header
        return json.loads(decompress(self._bytes(h.metadata_offset, h.metadata_length), h.internal_codec))

    def directory(self, offset: int, length: int) -> list[Entry]:
        return read_directory(decompress(self._bytes(offset, length), self.header.internal_codec))

    def root(self) -> list[Entry]:
        return self.directory(self.header.root_offset, self.header.root_length)

    def entries(self, directory: list[Entry] | None = None) -> Iterator[Entry]:
        for e in self.root() if directory is None else directory:
            if e.run:
                yield e
            else:
                yield from self.entries(self.directory(self.header.leaves_offset + e.offset, e.length))

    def data(self, e: Entry, raw: bool = False) -> bytes:
        found = self._bytes(self.header.data_offset + e.offset, e.length)
        return found if raw else decompress(found, self.header.tile_codec)


def zxy(tile_id: int) -> tuple[int, int, int]:
    """(z, x, y) of an archive id."""
    z, before = 0, 0
    while before + (1 << 2 * z) <= tile_id:
        before += 1 << 2 * z
        z += 1
    from .curves import hilbert_points

    x, y = hilbert_points([tile_id - before], z)
    # the curve of odd and even orders starts in different axes
    return z, int(x[0]), int(y[0])

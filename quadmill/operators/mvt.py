"""Mapbox Vector Tile encoding and decoding. Geometry commands are made per feature and tile, before tiles are put together."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from typing import Any

import numpy as np

from .geom import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry, orient
from .kernels import Box

UNKNOWN, POINTS, LINES, POLYGONS = range(4)
MOVE_TO, LINE_TO, CLOSE_PATH = 1, 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)."""
    n = shift = 0
    while True:
        if at >= len(raw) or shift >= 64:
            raise ValueError("varint runs out of the data or past 64 bits")
        b = raw[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def varints(values: np.ndarray) -> bytes:
    """Many small varints at once; values below 2^35."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    cols = np.stack([(v >> np.uint64(7 * i)) & np.uint64(0x7F) for i in range(5)], 1).astype(np.uint8)
    size = 1 + sum((v >> np.uint64(7 * i) > 0).astype(int) for i in range(1, 5))
    used = np.arange(5)[None, :] < size[:, None]
    more = np.arange(5)[None, :] < size[:, None] - 1
    return (cols | more.astype(np.uint8) << 7)[used].tobytes()


def point_geometries(pixels: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The geometries of many points one after another, and the bytes of each."""
    numbers = np.column_stack([np.full(len(pixels), MOVE_TO | 1 << 3, np.int64), zigzag(pixels)])
    sizes = 1 + sum((numbers >> 7 * i > 0).astype(int) for i in range(1, 5))
    return varints(numbers.ravel()), sizes.sum(axis=1)


def zigzag(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.int64)
    return (n << 1) ^ (n >> 63)


def pixels(coords: np.ndarray, tile: Box, extent: int) -> np.ndarray:
    """Whole tile pixels, rounded half away from zero, y downward."""
    p = np.stack([(coords[:, 0] - tile[0]) / (tile[2] - tile[0]) * extent, (1.0 - (coords[:, 1] - tile[1]) / (tile[3] - tile[1])) * extent], 1)
    return (np.sign(p) * np.floor(np.abs(p) + 0.5)).astype(np.int64)


def _deltas(p: np.ndarray, cursor: np.ndarray) -> np.ndarray:
    return zigzag(np.diff(np.concatenate([cursor[None, :], p]), axis=0)).reshape(-1)


def _ring(ring: np.ndarray, tile: Box, extent: int, cursor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(ring) < 4:
        return np.zeros(0, np.int64), cursor
    p = pixels(ring[:-1], tile, extent)
    d = _deltas(p, cursor)
    return np.r_[MOVE_TO | 1 << 3, d[:2], LINE_TO | (len(p) - 1) << 3, d[2:], CLOSE_PATH | 1 << 3], p[-1]


def commands(g: Geometry, tile: Box, extent: int = 4096) -> tuple[np.ndarray, int]:
    """(command integers, geometry type). Lines of fewer than 2 and rings of fewer than 4 points give none; the cursor
    goes on across the parts of a multi geometry; collections are of unknown type and empty."""
    kind, data = g
    cursor = np.zeros(2, np.int64)
    if kind in (POINT, MULTIPOINT):
        p = pixels(data.reshape(-1, 2), tile, extent)
        return (np.r_[MOVE_TO | len(p) << 3, _deltas(p, cursor)] if len(p) else np.zeros(0, np.int64)), POINTS
    out = [np.zeros(0, np.int64)]
    if kind in (LINE, MULTILINE):
        for line in [data] if kind == LINE else data:
            if len(line) >= 2:
                p = pixels(line, tile, extent)
                d = _deltas(p, cursor)
                out.append(np.r_[MOVE_TO | 1 << 3, d[:2], LINE_TO | (len(p) - 1) << 3, d[2:]])
                cursor = p[-1]
        return np.concatenate(out), LINES
    if kind in (POLYGON, MULTIPOLYGON):
        for rings in [data] if kind == POLYGON else data:
            for r in orient(rings):
                c, cursor = _ring(r, tile, extent, cursor)
                out.append(c)
        return np.concatenate(out), POLYGONS
    return out[0], UNKNOWN


def value_message(v: Any) -> bytes:
    """A protobuf Value: string 1, double 3, signed 4, unsigned 5, boolean 7. numpy's float32 is a float, 2."""
    if isinstance(v, (bool, np.bool_)):
        return b"\x38\x01" if v else b"\x38\x00"
    if isinstance(v, str):
        raw = v.encode()
        return b"\x0a" + varint(len(raw)) + raw
    if isinstance(v, np.float32):
        return b"\x15" + struct.pack("<f", v)
    if isinstance(v, np.unsignedinteger):
        return b"\x28" + varint(int(v))
    if isinstance(v, (int, np.integer)):
        return b"\x20" + varint(int(v) & (1 << 64) - 1)
    return b"\x19" + struct.pack("<d", v)


class Layer:
    """Puts the features of one tile together. Keys and values are numbered as they first appear; values of different types
    never share a number."""

    def __init__(self, name: str, extent: int = 4096):
        self.name, self.extent, self.count = name, extent, 0
        self.keys: dict[str, int] = {}
        self.values: dict[bytes, int] = {}
        self.features = bytearray()

    def add(self, feature_id: int | None, kind: int, geometry: bytes, tags: Iterable[tuple[str, bytes]] = ()) -> None:
        """geometry: the command integers as varints; tags: names and Value messages. Empty and of unknown type: left out."""
        if not geometry and kind == UNKNOWN:
            return
        numbers = b"".join(varint(self.keys.setdefault(k, len(self.keys))) + varint(self.values.setdefault(v, len(self.values))) for k, v in tags)
        f = b"" if feature_id is None else b"\x08" + varint(feature_id)
        f += (b"\x12" + varint(len(numbers)) + numbers if numbers else b"") + b"\x18" + varint(kind) + b"\x22" + varint(len(geometry)) + geometry
        self.features += b"\x12" + varint(len(f)) + f
        self.count += 1

    def tile(self) -> bytes:
        """The tile with this layer alone."""
        name = self.name.encode()
        keys = b"".join(b"\x1a" + varint(len(k.encode())) + k.encode() for k in self.keys)
        values = b"".join(b"\x22" + varint(len(v)) + v for v in self.values)
        layer = b"\x78\x02\x0a" + varint(len(name)) + name + bytes(self.features) + keys + values + b"\x28" + varint(self.extent)
        return b"\x1a" + varint(len(layer)) + layer


def _fields(raw: bytes) -> list[tuple[int, Any]]:
    at, out = 0, []
    while at < len(raw):
        key, at = read_varint(raw, at)
        if key & 7 == 0:
            v, at = read_varint(raw, at)
        elif key & 7 == 1:
            v, at = raw[at : at + 8], at + 8
        elif key & 7 == 5:
            v, at = raw[at : at + 4], at + 4
        else:
            n, at = read_varint(raw, at)
            v, at = raw[at : at + n], at + n
        out.append((key >> 3, v))
    return out


def _value(raw: bytes) -> Any:
    n, v = _fields(raw)[0]
    if n == 1:
        return v.decode()
    if n in (2, 3):
        return struct.unpack("<f" if n == 2 else "<d", v)[0]
    if n == 4:
        return v - (1 << 64) if v >> 63 else v
    return (v >> 1) ^ -(v & 1) if n == 6 else bool(v) if n == 7 else v


def _unpack(raw: bytes) -> list[int]:
    at, out = 0, []
    while at < len(raw):
        v, at = read_varint(raw, at)
        out.append(v)
    return out


def paths(numbers: list[int]) -> list[list[tuple[int, int]]]:
    """Pixel paths of command integers; closed rings end where they began."""
    out: list[list[tuple[int, int]]] = []
    x = y = i = 0
    while i < len(numbers):
        what, count = numbers[i] & 7, numbers[i] >> 3
        i += 1
        if what == CLOSE_PATH:
            out[-1].append(out[-1][0])
            continue
        for _ in range(count):
            x += (numbers[i] >> 1) ^ -(numbers[i] & 1)
            y += (numbers[i + 1] >> 1) ^ -(numbers[i + 1] & 1)
            i += 2
            if what == MOVE_TO:
                out.append([])
            out[-1].append((x, y))
    return out


def decode(tile: bytes) -> list[dict]:
    """Layers as dicts: name, extent, version, features with id, type, paths, properties."""
    layers = []
    for n, raw in _fields(tile):
        if n != 3:
            continue
        parts = _fields(raw)
        keys = [v.decode() for k, v in parts if k == 3]
        values = [_value(v) for k, v in parts if k == 4]
        features = []
        for k, v in parts:
            if k == 2:
                f = dict(_fields(v))
                tags = _unpack(f.get(2, b""))
                features.append({"id": f.get(1), "type": f.get(3, 0), "paths": paths(_unpack(f.get(4, b""))), "properties": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}})
        one = {k: v for k, v in parts if k in (1, 5, 15)}
        layers.append({"name": one.get(1, b"").decode(), "extent": one.get(5, 4096), "version": one.get(15, 1), "features": features})
    return layers

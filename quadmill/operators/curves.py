"""Tile boxes and Hilbert keys for numpy and plain Python, as the Column forms give them."""

from __future__ import annotations

import math

import numpy as np


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    n = 1 << z
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360.0 - 180.0, lat(y + 1), (x + 1) / n * 360.0 - 180.0, lat(y)


def tile_of(lng: float, lat: float, z: int) -> tuple[int, int]:
    n = 1 << z
    y = (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n
    return min(n - 1, max(0, math.floor((lng + 180) / 360 * n))), math.floor(min(n - 1.0, max(0.0, y)))


def hilbert_keys(x: np.ndarray, y: np.ndarray, order: int = 32) -> np.ndarray:
    """Hilbert positions of unsigned coordinates, as uint64."""
    x, y = np.asarray(x, np.uint64).copy(), np.asarray(y, np.uint64).copy()
    d, full = np.zeros(len(x), np.uint64), np.uint64((1 << order) - 1)
    for i in range(order - 1, -1, -1):
        rx, ry = x >> np.uint64(i) & np.uint64(1), y >> np.uint64(i) & np.uint64(1)
        d |= (np.uint64(3) * rx ^ ry) << np.uint64(2 * i)
        turn = (ry == 0) & (rx == 1)
        x[turn], y[turn] = full - x[turn], full - y[turn]
        swap = ry == 0
        x[swap], y[swap] = y[swap], x[swap]
    return d


def hilbert_points(d: np.ndarray, order: int = 32) -> tuple[np.ndarray, np.ndarray]:
    d = np.asarray(d, np.uint64)
    x, y = np.zeros(len(d), np.uint64), np.zeros(len(d), np.uint64)
    for i in range(order):
        t = d >> np.uint64(2 * i)
        rx = t >> np.uint64(1) & np.uint64(1)
        ry = (t ^ rx) & np.uint64(1)
        side = np.uint64((1 << i) - 1)
        turn = (ry == 0) & (rx == 1)
        x[turn], y[turn] = side - x[turn], side - y[turn]
        swap = ry == 0
        x[swap], y[swap] = y[swap], x[swap]
        x |= rx << np.uint64(i)
        y |= ry << np.uint64(i)
    return x, y


def world(lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """World coordinates of 32 bits; latitude is held within 89.9, longitude wrapped once."""
    lng = np.where(lng < -180, lng + 360, np.where(lng > 180, lng - 360, lng))
    r = np.radians(np.clip(lat, -89.9, 89.9))
    top = float(1 << 32)
    hold = lambda v: np.clip(v, 0, top - 1).astype(np.uint64)
    return hold((lng + 180) / 360 * top), hold((1 - np.log(np.tan(r) + 1 / np.cos(r)) / math.pi) / 2 * top)


def zorder_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def spread(v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, np.uint64)
        for shift, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | v << np.uint64(shift)) & np.uint64(m)
        return v

    return spread(x) << np.uint64(1) | spread(y)


def as_sortable(keys: np.ndarray) -> np.ndarray:
    """Signed integers in the order of unsigned ones."""
    return (keys ^ np.uint64(1 << 63)).view(np.int64)

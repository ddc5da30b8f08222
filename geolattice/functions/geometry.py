"""Geometry in well-known binary: bounds, emptiness, test against a rectangle.

Reads both byte orders, ISO and extended headers with Z, M and SRID, all seven classic
types and their nesting. Points whose x or y is NaN are empty.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parts(wkb: bytes) -> list[tuple[str, list[np.ndarray]]]:
    """The pieces of a geometry: ("point", [xy]), ("line", [xy]) or ("area", rings), each xy an n x 2 array."""
    out: list[tuple[str, list[np.ndarray]]] = []
    end = _read(memoryview(wkb), 0, out)
    if end != len(wkb):
        raise ValueError(f"{len(wkb) - end} bytes after the geometry")
    return out


def _read(data, at, out) -> int:
    order = {0: ">", 1: "<"}.get(data[at])
    if order is None:
        raise ValueError(f"byte order {data[at]}")
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    flags, code = code & 0xE0000000, code & 0x1FFFFFFF
    iso, kind = divmod(code, 1000)
    size = 2 + (1 if flags & 0x80000000 or iso in (1, 3) else 0) + (1 if flags & 0x40000000 or iso in (2, 3) else 0)
    if flags & 0x20000000:
        at += 4

    def count():
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    def points(n):
        nonlocal at
        if at + 8 * size * n > len(data):
            raise ValueError("the geometry is cut off")
        xy = np.frombuffer(data, order + "f8", n * size, at).reshape(n, size)[:, :2].astype("f8")
        at += 8 * size * n
        return xy

    if kind == 1:
        xy = points(1)
        if not np.isnan(xy).any():
            out.append(("point", [xy]))
    elif kind == 2:
        xy = points(count())
        if len(xy):
            out.append(("line", [xy]))
    elif kind == 3:
        rings = [r for r in (points(count()) for _ in range(count())) if len(r)]
        if rings:
            out.append(("area", rings))
    elif kind in (4, 5, 6, 7):
        for _ in range(count()):
            at = _read(data, at, out)
    else:
        raise ValueError(f"geometry type {code}")
    return at


def bounds_of(wkb: bytes | None):
    """(minx, miny, maxx, maxy), or None for a null or empty geometry."""
    xy = [r for _, rings in parts(wkb) for r in rings] if wkb is not None else []
    if not xy:
        return None
    xy = np.concatenate(xy)
    return (*xy.min(axis=0).tolist(), *xy.max(axis=0).tolist())


def meets_box(wkb: bytes | None, minx, miny, maxx, maxy) -> bool:
    """Whether a geometry and a closed rectangle share a point; null and empty geometries do not."""
    pieces = parts(wkb) if wkb is not None else []
    return any(_piece_meets(kind, rings, minx, miny, maxx, maxy) for kind, rings in pieces)


def _piece_meets(kind, rings, minx, miny, maxx, maxy) -> bool:
    xy = np.concatenate(rings)
    low, high = xy.min(axis=0), xy.max(axis=0)
    if high[0] < minx or low[0] > maxx or high[1] < miny or low[1] > maxy:
        return False
    inside = (xy[:, 0] >= minx) & (xy[:, 0] <= maxx) & (xy[:, 1] >= miny) & (xy[:, 1] <= maxy)
    if inside.any():
        return True
    if kind == "point":
        return False
    if any(_segments_meet(r, minx, miny, maxx, maxy) for r in rings):
        return True
    return kind == "area" and _covers(rings, minx, miny)


def _segments_meet(xy, minx, miny, maxx, maxy) -> bool:
    """Liang-Barsky clipping of all segments at once."""
    if len(xy) < 2:
        return False
    start, step = xy[:-1], np.diff(xy, axis=0)
    enter, leave = np.zeros(len(step)), np.ones(len(step))
    possible = np.ones(len(step), bool)
    for axis, low, high in ((0, minx, maxx), (1, miny, maxy)):
        p, d = start[:, axis], step[:, axis]
        still = d == 0
        possible &= ~still | ((p >= low) & (p <= high))
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (low - p) / d, (high - p) / d
        enter = np.where(still, enter, np.maximum(enter, np.minimum(a, b)))
        leave = np.where(still, leave, np.minimum(leave, np.maximum(a, b)))
    return bool((possible & (enter <= leave)).any())


def _covers(rings, x, y) -> bool:
    """Even-odd rule over all rings."""
    inside = False
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        crosses = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        inside ^= bool(np.count_nonzero(crosses & (x < at)) % 2)
    return inside


class Batch:
    """A binary Arrow array of geometries. Points and polygons of one ring, little-endian and flat, are read by whole columns.

    points and areas are places of rows; xy are their coordinates, areas' one after the
    other; first says where an area's begin, at where each coordinate pair lies in the data.
    rest are the places of other geometries, and null rows are in none.
    """

    def __init__(self, array):
        self.array = array
        wide = pa.types.is_large_binary(array.type)
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, "i8" if wide else "i4")[array.offset : array.offset + len(array) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start, size = offsets[:-1], np.diff(offsets)
        valid = array.is_valid().to_numpy(zero_copy_only=False)
        some = np.flatnonzero(valid & (size >= 21))
        order, code = self.data[start[some]], self._read(start[some] + 1, "<u4")
        is_point = (order == 1) & (code == 1) & (size[some] == 21)
        maybe = some[(order == 1) & (code == 3)]
        rings, n = self._read(start[maybe] + 5, "<u4"), self._read(start[maybe] + 9, "<u4").astype(np.int64)
        one = (rings == 1) & (n > 0) & (size[maybe] == 13 + 16 * n)
        self.points, self.areas, n = some[is_point], maybe[one], n[one]
        self.point_at, self.first = start[self.points] + 5, np.cumsum(n) - n
        self.area_at = np.repeat(start[self.areas] + 13 - 16 * self.first, n) + 16 * np.arange(n.sum())
        known = ~valid
        known[self.points] = known[self.areas] = True
        self.rest = np.flatnonzero(~known)

    def _read(self, at, kind):
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(width)]).view(kind).reshape(-1)

    def xy(self, at):
        """The coordinate pairs that begin at these bytes."""
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(16)]).view("<f8").reshape(-1, 2)

    def bounds(self):
        """An n x 4 array of minx, miny, maxx, maxy; NaN for null and empty geometries."""
        out = np.full((len(self.array), 4), np.nan)
        p = self.xy(self.point_at)
        p[np.isnan(p).any(axis=1)] = np.nan
        out[self.points] = np.hstack([p, p])
        if len(self.areas):
            xy = self.xy(self.area_at)
            out[self.areas] = np.hstack([np.minimum.reduceat(xy, self.first), np.maximum.reduceat(xy, self.first)])
        for i in self.rest:
            out[i] = bounds_of(self.array[int(i)].as_py()) or np.nan
        return out

    def meets(self, box):
        """Which geometries share a point with the closed rectangles in the n x 4 array box."""
        out = np.zeros(len(self.array), bool)
        inside = lambda xy, b: (xy[:, 0] >= b[:, 0]) & (xy[:, 0] <= b[:, 2]) & (xy[:, 1] >= b[:, 1]) & (xy[:, 1] <= b[:, 3])
        out[self.points] = inside(self.xy(self.point_at), box[self.points])
        left = self.rest
        if len(self.areas):
            xy, mine = self.xy(self.area_at), box[self.areas]
            low, high = np.minimum.reduceat(xy, self.first), np.maximum.reduceat(xy, self.first)
            apart = (high[:, 0] < mine[:, 0]) | (low[:, 0] > mine[:, 2]) | (high[:, 1] < mine[:, 1]) | (low[:, 1] > mine[:, 3])
            sizes = np.diff(np.append(self.first, len(xy)))
            corner = np.logical_or.reduceat(inside(xy, np.repeat(mine, sizes, axis=0)), self.first)
            out[self.areas] = corner
            # neither apart nor with a corner inside: edges may cross the rectangle, or the polygon hold it
            left = np.concatenate([left, self.areas[~apart & ~corner]])
        for i in left:
            out[i] = meets_box(self.array[int(i)].as_py(), *box[i])
        return out

    def moved(self, move):
        """The array with x, y = move(x, y) for all coordinate pairs of points and areas, and the places of others, which are as they were."""
        data = self.data.copy()
        for at in (self.point_at, self.area_at):
            if len(at):
                xy = self.xy(at)
                new = np.ascontiguousarray(np.stack(move(xy[:, 0], xy[:, 1]), axis=1), "<f8")
                data[at[:, None] + np.arange(16)] = new.view(np.uint8).reshape(-1, 16)
        validity, offsets, _ = self.array.buffers()
        return pa.Array.from_buffers(self.array.type, len(self.array), [validity, offsets, pa.py_buffer(data)], offset=self.array.offset), self.rest


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")]))
def st_bounds(wkb: pa.Array) -> pa.Array:
    """Bounds of each geometry; four nulls for null and empty ones."""
    bounds = Batch(wkb).bounds()
    return pa.StructArray.from_arrays([pa.array(bounds[:, k], from_pandas=True) for k in range(4)], ["minx", "miny", "maxx", "maxy"])


@F.arrow_udf(T.BooleanType())
def st_is_empty(wkb: pa.Array) -> pa.Array:
    """True for empty geometries, null for null."""
    empty = np.isnan(Batch(wkb).bounds()[:, 0])
    return pa.array(empty, mask=wkb.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.BooleanType())
def st_meets_box(wkb: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    """Exact test against a closed rectangle."""
    box = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in (minx, miny, maxx, maxy)], axis=1)
    return pa.array(Batch(wkb).meets(box))


def _records(columns, kind) -> pa.Array:
    """One binary value of a numpy record type for each row."""
    out = np.empty(len(columns[0]), kind)
    for name, values in zip(kind.names, columns):
        out[name] = values
    size = kind.itemsize
    offsets = pa.py_buffer(np.arange(0, size * (len(out) + 1), size, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(out), [None, offsets, pa.py_buffer(out.tobytes())])


def _without_nulls(wkb: pa.Array, inputs) -> pa.Array:
    nulls = np.zeros(len(wkb), bool)
    for x in inputs:
        nulls |= x.is_null().to_numpy(zero_copy_only=False)
    if not nulls.any():
        return wkb
    return pa.compute.if_else(pa.array(~nulls), wkb, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.BinaryType())
def st_point(x: pa.Array, y: pa.Array) -> pa.Array:
    """A little-endian point from two doubles; null if one is."""
    n, kind = len(x), np.dtype([("order", "u1"), ("code", "<u4"), ("x", "<f8"), ("y", "<f8")])
    a, b = (v.to_numpy(zero_copy_only=False) for v in (x, y))
    return _without_nulls(_records([np.ones(n), np.ones(n), a, b], kind), (x, y))


@F.arrow_udf(T.BinaryType())
def st_rectangle(minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    """A little-endian polygon of one ring from four doubles; null if one is."""
    a, b, c, d = (v.to_numpy(zero_copy_only=False) for v in (minx, miny, maxx, maxy))
    one = np.ones(len(a))
    ring = [a, b, c, b, c, d, a, d, a, b]
    kind = np.dtype([("order", "u1"), ("code", "<u4"), ("rings", "<u4"), ("n", "<u4"), *((f"v{k}", "<f8") for k in range(10))])
    return _without_nulls(_records([one, one * 3, one, one * 5, *ring], kind), (minx, miny, maxx, maxy))

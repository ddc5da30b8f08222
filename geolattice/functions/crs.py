"""Coordinate reference systems: labels, and Web Mercator and UTM to longitude and latitude, in closed form."""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import Batch

WGS84 = "EPSG:4326"
RADIUS = 6378137.0


def crs_of(df: DataFrame, geometry: str = "geometry") -> str | None:
    return df.schema[geometry].metadata.get("crs")


def set_crs(df: DataFrame, crs: str, geometry: str = "geometry") -> DataFrame:
    """df with the label, coordinates as they are."""
    return df.withMetadata(geometry, {**df.schema[geometry].metadata, "crs": crs})


def to_wgs84(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """df in longitude and latitude: labelled if it has no label, as it is if it has this one, else reprojected."""
    crs = crs_of(df, geometry)
    if crs is None or crs == WGS84:
        return set_crs(df, WGS84, geometry)
    if crs in ("EPSG:3857", "EPSG:900913"):
        move = from_mercator
    elif zone := re.fullmatch(r"EPSG:32([67])(0[1-9]|[1-5]\d|60)", crs):
        move = from_utm(int(zone[2]), zone[1] == "7")
    else:
        raise RuntimeError(f"Unable to reproject {crs} to {WGS84}")
    return set_crs(df.withColumn(geometry, _reproject(move)(geometry)), WGS84, geometry)


def from_mercator(x, y):
    """Longitude and latitude of spherical Mercator coordinates."""
    return np.degrees(x / RADIUS), np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - math.pi / 2)


def from_utm(zone: int, south: bool):
    """A function from a zone's eastings and northings to longitude and latitude: Krueger's series to the fourth power of n (below a millimetre)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    size = 0.9996 * RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # fixed values: coefficients of the published series
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    def move(x, y):
        xi, eta = (y - 1e7 * south) / size, (x - 5e5) / size
        a, b = xi.copy(), eta.copy()
        for j, k in enumerate(beta, 1):
            a -= k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            b -= k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        conformal = np.arcsin(np.sin(a) / np.cosh(b))
        lat = conformal + sum(k * np.sin(2 * j * conformal) for j, k in enumerate(delta, 1))
        return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(b), np.cos(a))), np.degrees(lat)

    return move


def _reproject(move):
    @F.arrow_udf(T.BinaryType())
    def run(wkb: pa.Array) -> pa.Array:
        array, rest = Batch(wkb).moved(move)
        if not len(rest):
            return array
        rows = array.to_pylist()
        for i in rest.tolist():
            data = bytearray(rows[i])
            _move(data, 0, move)
            rows[i] = bytes(data)
        return pa.array(rows, pa.binary())

    return run


def _move(data, at, move) -> int:
    """Moves the geometry at a place in data; returns where it ends."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5 + 4 * bool(code & 0x20000000)
    iso, kind = divmod(code & 0x1FFFFFFF, 1000)
    size = 2 + bool(code & 0x80000000 or iso in (1, 3)) + bool(code & 0x40000000 or iso in (2, 3))

    def points(n, at):
        xy = np.frombuffer(data, order + "f8", n * size, at).reshape(n, size).copy()
        xy[:, 0], xy[:, 1] = move(xy[:, 0].astype(float), xy[:, 1].astype(float))
        data[at : at + xy.nbytes] = xy.tobytes()
        return at + xy.nbytes

    if kind == 1:
        return points(1, at)
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 2:
        return points(n, at)
    for _ in range(n):
        if kind == 3:
            (m,) = struct.unpack_from(order + "I", data, at)
            at = points(m, at + 4)
        else:
            at = _move(data, at, move)
    return at

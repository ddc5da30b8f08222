"""Shapefiles as a Spark data source: .shp geometries, .dbf attributes, .prj label."""

from __future__ import annotations

import codecs
import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records that one task reads.
RECORDS = 50_000


def _fields(data: bytes):
    """(name, kind, size, decimals) of a .dbf header, and the header's and a record's size."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name, kind, length, decimals = struct.unpack_from("<11sc4xBB", data, at)
        fields.append((name.split(b"\0")[0].decode("latin-1"), kind.decode(), length, decimals))
        at += 32
    return fields, n, head, size


def _type(kind, size, decimals):
    if kind in "NF":
        return T.DoubleType() if decimals or kind == "F" or size > 18 else T.LongType()
    return T.BooleanType() if kind == "L" else T.StringType()


def _value(raw: bytes, spark_type, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    if isinstance(spark_type, T.BooleanType):
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if isinstance(spark_type, T.StringType):
        return text
    return float(text) if isinstance(spark_type, T.DoubleType) else int(text)


def _ring_area(points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2


def _holds(ring, point) -> bool:
    """Whether a ring goes around a point, by the even-odd rule."""
    x, y = point
    crossed = [a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > x for a, b in zip(ring, ring[1:]) if (a[1] > y) != (b[1] > y)]
    return sum(crossed) % 2 == 1


def _wkb(record: bytes) -> bytes | None:
    """Little-endian WKB of one shape; Z and M are left out. Outer rings run clockwise in shapefiles."""
    (kind,) = struct.unpack_from("<i", record)
    base = {0: 0, 1: 1, 11: 1, 21: 1, 3: 3, 13: 3, 23: 3, 5: 5, 15: 5, 25: 5, 8: 8, 18: 8, 28: 8}.get(kind)
    if base is None:
        raise ValueError(f"shape type {kind} is not supported")
    if base == 0:
        return None
    if base == 1:
        return struct.pack("<BIdd", 1, 1, *struct.unpack_from("<2d", record, 4))
    if base == 8:
        (n,) = struct.unpack_from("<i", record, 36)
        points = [struct.unpack_from("<2d", record, 40 + 16 * k) for k in range(n)]
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BIdd", 1, 1, *p) for p in points)
    parts, n = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), n]
    at = 44 + 4 * parts
    lines = [[struct.unpack_from("<2d", record, at + 16 * k) for k in range(a, b)] for a, b in zip(starts, starts[1:])]
    flat = lambda x: struct.pack("<I", len(x)) + b"".join(struct.pack("<2d", *p) for p in x)
    if base == 3:
        return struct.pack("<BII", 1, 5, parts) + b"".join(struct.pack("<BI", 1, 2) + flat(x) for x in lines)
    areas = []
    for ring in sorted(lines, key=lambda r: _ring_area(r) > 0):  # outer rings first
        if _ring_area(ring) <= 0 or not areas:
            areas.append([ring])
        else:
            next((a for a in areas if _holds(a[0], ring[0])), areas[-1]).append(ring)
    return struct.pack("<BII", 1, 6, len(areas)) + b"".join(struct.pack("<BII", 1, 3, len(a)) + b"".join(map(flat, a)) for a in areas)


def crs_label(path: str) -> str | None:
    """EPSG code of the .prj beside a .shp, by its authority or, for two common systems, its name."""
    prj = Path(path).with_suffix(".prj")
    if not prj.exists():
        return None
    text = prj.read_text()
    if codes := re.findall(r'AUTHORITY\["EPSG","?(\d+)"?\]', text):
        return f"EPSG:{codes[-1]}"
    if re.search("Pseudo.Mercator|Web_Mercator", text, re.I):
        return "EPSG:3857"
    return "EPSG:4326" if re.match(r'GEOGCS\["(GCS_)?WGS[ _](19)?84', text) else f"unknown:{text[:60]}"


def _encoding(path) -> str:
    """The attributes' encoding by the .cpg beside a .shp; UTF-8 without one or with one that Python doesn't know."""
    cpg = Path(path).with_suffix(".cpg")
    name = cpg.read_text("ascii", "replace").strip() if cpg.exists() else "utf-8"
    for guess in (name, f"cp{name}", name.replace("ANSI ", "cp"), "utf-8"):
        try:
            return codecs.lookup(guess).name
        except LookupError:
            pass


class _Part(InputPartition):
    """Records first to last of a file, or all of them."""

    def __init__(self, first, last):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path, schema):
        self.path, self.schema = path, schema

    def partitions(self):
        """RECORDS records each, where the .shx says where they are."""
        index = Path(self.path).with_suffix(".shx")
        if not index.exists():
            return [_Part(0, None)]
        n = (index.stat().st_size - 100) // 8
        return [_Part(a, min(a + RECORDS, n)) for a in range(0, n, RECORDS)] or [_Part(0, 0)]

    def _records(self, part):
        """Number and shape of each record of a part."""
        with open(self.path, "rb") as file:
            if part.last is None:
                file.seek(100)
                k = 0
                while len(head := file.read(8)) == 8:
                    yield k, file.read(2 * struct.unpack(">2i", head)[1])
                    k += 1
                return
            with open(Path(self.path).with_suffix(".shx"), "rb") as index:
                index.seek(100 + 8 * part.first)
                places = index.read(8 * (part.last - part.first))
            for k, (at, words) in enumerate(struct.iter_unpack(">2i", places), part.first):
                file.seek(2 * at + 8)
                yield k, file.read(2 * words)

    def read(self, partition):
        encoding = _encoding(self.path)
        with open(Path(self.path).with_suffix(".dbf"), "rb") as table:
            fields, _, head, size = _fields(_header(table))
            for k, shape in self._records(partition):
                table.seek(head + k * size)
                row = table.read(size)
                values, start = [], 1
                for (_, _, length, _), field in zip(fields, self.schema.fields):
                    values.append(_value(row[start : start + length], field.dataType, encoding))
                    start += length
                if row[:1] != b"*":
                    yield (*values, _wkb(shape))


def _header(table) -> bytes:
    """The header of an open .dbf."""
    start = table.read(32)
    return start + table.read(struct.unpack_from("<H", start, 8)[0] - 32)


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load("x.shp"), once registered."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        with open(Path(self.options["path"]).with_suffix(".dbf"), "rb") as table:
            fields, *_ = _fields(_header(table))
        return T.StructType([*(T.StructField(n, _type(k, s, d)) for n, k, s, d in fields), T.StructField("geometry", T.BinaryType())])

    def reader(self, schema):
        return _Reader(self.options["path"], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A shapefile with its CRS label; one without features is an error."""
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("shapefile").load(str(path))
    if df.isEmpty():
        raise RuntimeError(f"{path} has no features")
    crs = crs_label(path)
    return df.withMetadata("geometry", {"crs": crs}) if crs else df

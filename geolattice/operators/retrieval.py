"""Retrieval from a GeoParquet dataset by boxes: whole, in chunks, and as counts for cells."""

from __future__ import annotations

import datetime
import math
import struct
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import BOX, has_source, overlaps
from ..functions.geometry import bounds_of, st_bounds, st_meets_box
from ..plans.cells import CELL_BOX, pairs
from ..shared import cut, fresh
from ..sources.geoparquet import FileIndex, check_box


class FeatureStore:
    """A directory of GeoParquet files and the index of their boxes, which is built from the footers or was kept before."""

    def __init__(self, spark: SparkSession, base_path, index: FileIndex | None = None):
        self.spark, self.base_path = spark, str(base_path)
        self._closed = False
        self.index = index or FileIndex.build(spark, self.base_path)

    def refresh(self) -> None:
        """Reads the footers anew."""
        self.index = FileIndex.build(self.spark, self.base_path)

    @property
    def geometry_column(self) -> str:
        return self.index.geometry_column

    @property
    def file_count(self) -> int:
        return len(self.index.entries)

    def close(self) -> None:
        """Ends this handle, not the session; may be called again."""
        self._closed = True

    def _scan(self, files) -> DataFrame:
        """Lazily, the given files; with none, no rows of the same schema."""
        if self._closed:
            raise RuntimeError("The store has been closed.")
        if files:
            return self.spark.read.parquet(*files)
        return self.spark.read.parquet(self.index.entries[0].path).limit(0)

    def _meeting(self, box) -> DataFrame:
        """The features that meet a box. With a box column in the files, Parquet's statistics and native tests settle all but the rows whose box only crosses the edge."""
        rows = self._scan(self.index.candidates(box))
        geometry, sides = F.col(f"`{self.geometry_column}`"), [F.lit(x) for x in box]
        if not self.index.covering:
            return rows.where(st_meets_box(geometry, *sides))
        minx, miny, maxx, maxy = (F.col(c) for c in self.index.covering)
        # a row whose box is not there is not settled
        for side, reaches in ((minx, minx <= sides[2]), (maxx, maxx >= sides[0]), (miny, miny <= sides[3]), (maxy, maxy >= sides[1])):
            rows = rows.where(side.isNull() | reaches)
        within = F.coalesce((minx >= sides[0]) & (maxx <= sides[2]) & (miny >= sides[1]) & (maxy <= sides[3]), F.lit(False))
        return rows.where(within | st_meets_box(F.when(~within, geometry), *sides))

    def _project(self, rows: DataFrame, columns) -> DataFrame:
        """The given columns or expressions, each once; all for none. A name that is a column is taken as such, whatever is in it."""
        if not columns:
            return rows
        names = {c.lower() for c in rows.columns}
        return rows.select(*(F.col(f"`{c}`") if c.lower() in names else F.expr(c) for c in dict.fromkeys(columns)))

    def query_bbox(self, minx, miny, maxx, maxy, *, columns=None, limit=None) -> DataFrame:
        """Features whose geometry meets the closed box. No files that match give no rows of the real schema."""
        if limit is not None and limit < 0:
            raise ValueError("limit must not be negative")
        rows = self._project(self._meeting(check_box(minx, miny, maxx, maxy)), columns)
        return rows if limit is None else rows.limit(limit)

    def iter_bbox(self, minx, miny, maxx, maxy, *, chunk_size: int = 10_000, columns=None) -> Iterator:
        """The same rows as pandas frames of at most chunk_size, from one execution. The driver gets whole Arrow batches, a partition at a time."""
        if chunk_size <= 0:
            raise ValueError("chunk_size must be above 0")
        import pyarrow as pa

        def packed(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, chunk_size):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(k, chunk_size))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

        rows, held = self.query_bbox(minx, miny, maxx, maxy, columns=columns), None
        for row in rows.mapInArrow(packed, "data binary").toLocalIterator(prefetchPartitions=True):
            more = pa.ipc.open_stream(row.data).read_all()
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= chunk_size:
                yield held.slice(0, chunk_size).to_pandas()
                held = held.slice(chunk_size)
        if held is not None and held.num_rows:
            yield held.to_pandas()

    def collect_bbox_statistics(self, rows, *, geometry_field: str = "geometry", metadata_fields=None, dataset: str | None = "OpenStreetMap", index_field: str | None = None, loop: bool = False, tile: float | None = None):
        """(results, log): for each row with a geometry, how many features meet its bounds, and how many name dataset.

        results: metadata_fields, geometry, buildings_count, osm_buildings_count; log:
        feature_index, the bounds, the counts, candidate_file_count and duration_seconds. The
        last column of counts is absent where dataset is None. One job counts for all
        rows and leaves durations null; loop runs a job for each row and times it. Rows with
        null or empty geometries are in neither frame but keep their place in the numbering.

        rows: a Spark DataFrame, a pandas or GeoPandas frame (numbered by its index), or
        dicts and objects with fields or get(). A geometry is WKB, or an object with bounds
        (its wkb is kept if it has one, else a rectangle); others are an error.
        """
        fields = list(metadata_fields or ())
        cells = cut(self._cells(rows, geometry_field, fields, index_field))
        files = self.index.frame(self.spark)
        near = cut(pairs(files, cells.select("cell", *CELL_BOX)).select("cell", "path"))
        candidates = near.groupBy("cell").agg(F.count("*").alias("candidate_file_count"))
        # as many paths as the index has at most
        paths = [r.path for r in near.select("path").distinct().collect()]
        counted = cut(self._loop(cells, dataset) if loop else self._batch(cells, dataset, tile, paths))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        joined = cells.join(counted, "cell", "left").join(candidates, "cell", "left")
        counts = {"buildings_count": zero("n"), "osm_buildings_count": zero("n_tagged")}
        if dataset is None:
            counts.pop("osm_buildings_count")
        metadata = {f: F.col("meta")[f] for f in fields if f not in counts}
        order = {**metadata, **({} if "geometry" in metadata else {"geometry": F.col("geometry")}), **counts}
        results = joined.select(*(v.alias(k) for k, v in order.items()))
        log = joined.select(
            F.col("cell").alias("feature_index"),
            *(F.col(c).alias(b) for c, b in zip(CELL_BOX, BOX)),
            counts["buildings_count"].alias("buildings_count"),
            zero("candidate_file_count").alias("candidate_file_count"),
            F.col("duration_seconds") if loop else F.lit(None).cast("double").alias("duration_seconds"),
            *([counts["osm_buildings_count"].alias("osm_buildings_count")] if dataset is not None else []),
        )
        return results, log

    def _cells(self, rows, geometry_field, fields, index_field) -> DataFrame:
        """cell, geometry, meta and bounds of the rows that have a geometry."""
        if not isinstance(rows, DataFrame):
            return self._from_python(rows, geometry_field, fields)
        present = [F.col(f"`{f}`") if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]
        meta = F.struct(*present) if fields else F.struct(F.lit(0).alias("none"))
        if index_field is None:
            (index_field,) = fresh(rows.columns, "place")
            rows = numbered(rows, index_field)
        named = rows.select(F.col(f"`{index_field}`").alias("cell"), F.col(f"`{geometry_field}`").alias("geometry"), meta.alias("meta"))
        boxed = named.withColumn("b", st_bounds("geometry")).where("b.minx IS NOT NULL")
        return boxed.select("cell", "geometry", "meta", *(F.col(f"b.{b}").alias(c) for b, c in zip(BOX, CELL_BOX)))

    def _from_python(self, rows: Iterable, geometry_field, fields) -> DataFrame:
        """As _cells(), from a pandas frame or from dicts and objects; absent fields are null."""
        data, names = [], []
        for index, row in rows.iterrows() if hasattr(rows, "iterrows") else enumerate(rows):
            wkb, box = as_geometry(_field(row, geometry_field))
            if box is not None:
                names.append(index)
                data.append((wkb, [_plain(_field(row, f)) for f in fields], *check_box(*box)))
        try:
            names, kind = [int(x) for x in names], "long"
        except (TypeError, ValueError):
            names, kind = [str(x) for x in names], "string"
        kinds = [_kind([d[1][j] for d in data]) for j in range(len(fields))]
        meta = ", ".join(f"`{f}`: {k}" for f, (k, _) in zip(fields, kinds)) or "none: int"
        made = [(n, w, tuple(None if v is None else make(v) for v, (_, make) in zip(m, kinds)) or (0,), *b) for n, (w, m, *b) in zip(names, data)]
        schema = f"cell {kind}, geometry binary, meta struct<{meta}>, " + ", ".join(f"{c} double" for c in CELL_BOX)
        return self.spark.createDataFrame(made, schema)

    def _features(self, files, dataset) -> DataFrame:
        rows = self._scan(files)
        tag = has_source("sources", dataset) if dataset is not None and "sources" in rows.columns else F.lit(False)
        rows = rows.select(F.col(f"`{self.geometry_column}`").alias("g"), tag.alias("tagged"), *(F.col(c).cast("double").alias(b) for c, b in zip(self.index.covering or (), BOX)))
        if self.index.covering:
            return rows
        return rows.withColumn("b", st_bounds("g")).select("g", "tagged", "b.*")

    def _batch(self, cells, dataset, tile, files) -> DataFrame:
        """One job: only files that meet some cell are read, only pairs whose boxes do not settle it are tested exactly."""
        found = pairs(self._features(files, dataset), cells.select("cell", *CELL_BOX), tile)
        within = (F.col("minx") >= F.col("cminx")) & (F.col("maxx") <= F.col("cmaxx")) & (F.col("miny") >= F.col("cminy")) & (F.col("maxy") <= F.col("cmaxy"))
        met = found.where(within | st_meets_box(F.when(~within, F.col("g")), *CELL_BOX))
        return met.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("tagged").alias("n_tagged"))

    def _loop(self, cells, dataset) -> DataFrame:
        out = []
        for row in cells.select("cell", *CELL_BOX).toLocalIterator():
            start = time.perf_counter()
            rows = self._meeting(tuple(row)[1:])
            tag = has_source("sources", dataset) if dataset is not None and "sources" in rows.columns else F.lit(False)
            n, tagged = rows.agg(F.count("*"), F.count_if(tag)).first()
            out.append((row[0], n, tagged, time.perf_counter() - start))
        kind = cells.schema["cell"].dataType.simpleString()
        return self.spark.createDataFrame(out, f"cell {kind}, n long, n_tagged long, duration_seconds double")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with each row's number from 0, in the order of its partitions; rows are kept once, then each partition's numbers shifted."""
    part, at = fresh([*df.columns, name], "part", "at")
    kept = cut(df.withColumn(at, F.monotonically_increasing_id()))
    kept = kept.withColumn(part, F.shiftrightunsigned(at, 33))
    sizes = kept.groupBy(part).count().orderBy(part).collect()  # a row for each partition
    start, before = 0, []
    for p, n in sizes:
        before += [F.lit(p), F.lit(start)]
        start += n
    shift = F.try_element_at(F.create_map(*before), F.col(part)) if before else F.lit(0)
    place = (F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + shift).cast("long")
    return kept.withColumn(name, place).drop(part, at)


def where_meets(df: DataFrame, minx, miny, maxx, maxy, geometry: str = "geometry") -> DataFrame:
    """The rows of any frame whose geometry meets the closed box; none is an error."""
    found = df.where(st_meets_box(F.col(f"`{geometry}`"), *(F.lit(x) for x in check_box(minx, miny, maxx, maxy))))
    if found.isEmpty():
        raise RuntimeError("No geometry meets the box")
    return found


def where_box_meets(df: DataFrame, minx, miny, maxx, maxy, box=BOX) -> DataFrame:
    """The rows whose box, in four columns, meets the closed one; native, and pushed down to the files."""
    return df.where(overlaps(*box, check_box(minx, miny, maxx, maxy)))


def as_geometry(value):
    """(WKB, bounds) of WKB or of an object with bounds, bounds None for a null or empty one."""
    if value is None or value != value:
        return None, None
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value), bounds_of(bytes(value))
    if getattr(value, "is_empty", False):
        return None, None
    if not hasattr(value, "bounds"):
        raise ValueError("A geometry must be WKB or have bounds")
    a, b, c, d = box = tuple(map(float, value.bounds))
    wkb = getattr(value, "wkb", None)
    return bytes(wkb) if wkb is not None else struct.pack("<BIII10d", 1, 3, 1, 5, a, b, c, b, c, d, a, d, a, b), box


def _field(row, name):
    """A field of a dict, of anything with get(), or an attribute; None where there is none."""
    if hasattr(row, "get"):
        try:
            return row.get(name)
        except TypeError:
            pass
    return getattr(row, name, None)


def _plain(value):
    """A value as Python's own types have it; None for what pandas and numpy take as absent."""
    value = value.item() if hasattr(value, "item") and getattr(value, "ndim", 0) == 0 else value
    if value is None or type(value).__name__ in ("NAType", "NaTType") or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.to_pydatetime() if hasattr(value, "to_pydatetime") else value


def _kind(values):
    """The type of a column and what makes a value one of it: numbers widen, what has no common type becomes text."""
    found = {type(v) for v in values if v is not None}
    if found == {bool}:
        return "boolean", bool
    if found and found <= {int, bool}:
        return ("long", int) if all(-(1 << 63) <= v < 1 << 63 for v in values if v is not None) else ("string", str)
    if found and found <= {int, float, bool}:
        return "double", float
    if found and found <= {bytes, bytearray}:
        return "binary", bytes
    if found == {datetime.datetime}:
        return "timestamp", lambda v: v
    if found == {datetime.date}:
        return "date", lambda v: v
    return "string", str


__all__ = ["FeatureStore", "bounds_of"]

"""GeoParquet: discovery, footers, the index of file boxes, and a writer with a geo footer.

Paths may be of any file system that Spark reads; discovery and footers go by Spark's own readers.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.columns import BOX
from ..functions.geometry import Batch

BBox = tuple[float, float, float, float]
#: Footers that are read at a time.
READERS = 32


def list_files(spark: SparkSession, base) -> list[str]:
    """All Parquet files below base at any depth, sorted by path. A base that is not there is an error; files and folders that Spark hides (_ and . names) do not count."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        return sorted((r.path for r in rows.load(str(base)).select("path").collect()), key=lambda p: p.split("/"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"No such directory: {base}") from error
        raise


def directory_label(spark: SparkSession, path: str, base) -> str:
    """The directory of a file relative to base, "." for base itself."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(str(base))
    root = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    return path[len(root) :].rpartition("/")[0].strip("/") or "."


def files_by_directory(spark: SparkSession, base) -> dict[str, list[str]]:
    """Files of each directory, which is named relative to base, "." for base itself; none at all is an error."""
    found = defaultdict(list)
    for path in list_files(spark, base):
        found[directory_label(spark, path, base)].append(path)
    if not found:
        raise FileNotFoundError(f"No Parquet files below {base}")
    return dict(sorted(found.items()))


def footers(spark: SparkSession, paths: Iterable[str], key: str | None = None) -> Iterator:
    """For each file the key-value pairs of its footer, or the value of one key or None; many files are read at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def one(path):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(path)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            pairs = reader.getFooter().getFileMetaData().getKeyValueMetaData()
            return dict(pairs) if key is None else pairs.get(key)
        finally:
            reader.close()

    with ThreadPoolExecutor(READERS) as pool:
        yield from pool.map(one, paths)


def footer(spark: SparkSession, path) -> dict[str, str]:
    """Key-value pairs of a file's footer as text."""
    return next(footers(spark, [path]))


def check_box(minx, miny, maxx, maxy) -> BBox:
    """Four finite numbers in order; equal ones are allowed."""
    box = tuple(float(x) for x in (minx, miny, maxx, maxy))
    if not all(map(math.isfinite, box)):
        raise ValueError(f"Box limits must be finite: {box}")
    if box[0] > box[2] or box[1] > box[3]:
        raise ValueError(f"A box's lower limits must not exceed its upper ones: {box}")
    return box


@dataclass(frozen=True)
class FileEntry:
    """A file and the box of its geometries, or None if it has none but null and empty ones."""

    path: str
    bbox: BBox | None

    def intersects(self, box: BBox) -> bool:
        """Whether the two closed boxes share a point."""
        return self.bbox is not None and all(self.bbox[k] <= box[k + 2] and box[k] <= self.bbox[k + 2] for k in (0, 1))


@dataclass(frozen=True)
class FileIndex:
    """The files of a dataset that carry a geo footer, in order of path, their geometry column, and its box column if all name one."""

    geometry_column: str
    entries: tuple[FileEntry, ...]
    covering: tuple[str, ...] | None = None

    @classmethod
    def build(cls, spark: SparkSession, base) -> FileIndex:
        """Reads all footers below base. Files without a geo footer, or an empty one, are passed over.

        A file whose geometry column is marked as empty, as write() marks one without
        geometries, has no box and meets nothing; any other must have one.
        """
        primary, entries, covering = None, [], set()
        paths = list_files(spark, base)
        for path, text in zip(paths, footers(spark, paths, "geo")):
            if not text:
                continue
            try:
                geo = json.loads(text)
            except ValueError as error:
                raise ValueError(f"The geo footer of {path} is no JSON") from error
            column = geo.get("primary_column")
            if not column:
                raise ValueError(f"The geo footer of {path} names no primary column")
            if primary not in (None, column):
                raise ValueError(f"{path} has the geometry column {column}, others have {primary}")
            primary = column
            about = (geo.get("columns") or {}).get(column, {})
            box = about.get("bbox")
            if about.get("empty") is True and box is None:
                entries.append(FileEntry(path, None))
                continue
            if not isinstance(box, list) or len(box) != 4 or not all(math.isfinite(float(x)) for x in box):
                raise ValueError(f"The geo footer of {path} has no bbox of four numbers for {column}")
            entries.append(FileEntry(path, tuple(map(float, box))))
            sides = (about.get("covering") or {}).get("bbox") or {}
            names = ["xmin", "ymin", "xmax", "ymax"]
            covering.add(tuple(".".join(f"`{x}`" for x in sides[n]) for n in names) if all(n in sides for n in names) else None)
        if primary is None:
            raise FileNotFoundError(f"No file with a geo footer below {base}")
        return cls(primary, tuple(entries), covering.pop() if len(covering) == 1 else None)

    def candidates(self, box: BBox) -> list[str]:
        """Files whose box meets the given one."""
        return [e.path for e in self.entries if e.intersects(box)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """path, minx, miny, maxx, maxy; the last four null for a file without geometries."""
        rows = [(e.path, *(e.bbox or (None,) * 4)) for e in self.entries]
        return spark.createDataFrame(rows, "path string, minx double, miny double, maxx double, maxy double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Keeps the index as a table, so that later handles need not read the footers."""
        rows = self.frame(spark).withColumns({"geometry_column": F.lit(self.geometry_column), "covering": F.lit(json.dumps(self.covering))})
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FileIndex:
        """An index that save() kept."""
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.path.split("/"))
        entries = tuple(FileEntry(r.path, None if r.minx is None else tuple(r[b] for b in BOX)) for r in rows)
        covering = json.loads(rows[0].covering)
        return cls(rows[0].geometry_column, entries, covering and tuple(covering))


def scan(spark: SparkSession, paths, *, may_be_empty: bool = True) -> DataFrame:
    """A file, a directory, a glob such as dir/*.parquet, or a list of them. With may_be_empty=False no rows are an error."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else map(str, paths)))
    if not may_be_empty and df.isEmpty():
        raise RuntimeError(f"{paths} has no rows")
    return df


def read(spark: SparkSession, path, geometry: str | None = None) -> DataFrame:
    """A GeoParquet file or directory; the geometry column carries its CRS label, that of the first file with a geo footer."""
    df = spark.read.parquet(str(path))
    geo = next((json.loads(x) for p in list_files(spark, path) if (x := next(footers(spark, [p], "geo")))), {})
    column = geometry or geo.get("primary_column")
    if not column or column not in df.columns:
        return df
    crs = (geo.get("columns") or {}).get(column, {}).get("crs", "EPSG:4326")
    if isinstance(crs, dict):
        ident = crs.get("id") or {}
        crs = f"{ident.get('authority', 'EPSG')}:{ident.get('code', 4326)}"
    return df.withMetadata(column, {"crs": crs})


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """One file for each task with rows, under a hidden folder until all tasks are done; what a task that failed left there goes."""

    def __init__(self, options, overwrite):
        self.options, self.overwrite = dict(options), overwrite

    def _folder(self):
        from pyarrow import fs

        path = self.options["path"]
        if "://" in path or path.startswith("file:"):
            if path.startswith("file:"):
                return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            return fs.FileSystem.from_uri(path)
        return fs.LocalFileSystem(), path

    def write(self, iterator):
        import uuid

        import numpy as np
        from pyarrow import parquet

        geometry, (files, path) = self.options["geometry"], self._folder()
        writer, name, low, high = None, f"part-{uuid.uuid4().hex}.parquet", np.full(2, np.inf), np.full(2, -np.inf)
        hidden = f"{path}/_temporary-{self.options['job']}"
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(hidden, recursive=True)
                writer = parquet.ParquetWriter(f"{hidden}/{name}", batch.schema, filesystem=files)
            boxes = Batch(batch.column(batch.schema.get_field_index(geometry))).bounds()
            boxes = boxes[~np.isnan(boxes).any(axis=1)]
            if len(boxes):
                low, high = np.minimum(low, boxes[:, :2].min(axis=0)), np.maximum(high, boxes[:, 2:].max(axis=0))
            writer.write_batch(batch)
        if writer is None:
            return _Written([])
        authority, _, code = self.options["crs"].partition(":")
        about = {"encoding": "WKB", "geometry_types": [], "crs": {"id": {"authority": authority, "code": int(code) if code.isdigit() else code}}}
        about |= {"bbox": [*low.tolist(), *high.tolist()]} if np.isfinite(low).all() else {"empty": True}
        if cover := self.options.get("covering"):
            about["covering"] = {"bbox": {k: [cover, k] for k in ("xmin", "ymin", "xmax", "ymax")}}
        writer.add_key_value_metadata({"geo": json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: about}})})
        writer.close()
        return _Written([name])

    def commit(self, messages):
        from pyarrow import fs

        files, path = self._folder()
        new = {n for m in messages if m for n in m.names}
        hidden = f"{path}/_temporary-{self.options['job']}"
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if info.type == fs.FileType.File and info.base_name.endswith(".parquet"):
                    files.delete_file(info.path)
        for name in sorted(new):
            files.move(f"{hidden}/{name}", f"{path}/{name}")
        self._clear(files, hidden)

    def abort(self, messages):
        files, path = self._folder()
        self._clear(files, f"{path}/_temporary-{self.options['job']}")

    def _clear(self, files, hidden):
        from pyarrow import fs

        if files.get_file_info(hidden).type != fs.FileType.NotFound:
            files.delete_dir(hidden)


class GeoParquetSink(DataSource):
    """df.write.format("geoparquet"), once registered; options geometry, crs, covering and job."""

    @classmethod
    def name(cls):
        return "geoparquet"

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def write(df: DataFrame, path, geometry: str = "geometry", mode: str = "append", covering: str | None = None) -> bool:
    """Writes df as GeoParquet, a file for each partition that has rows; nothing, and False, for an empty df.

    Spark's own writer cannot set footer keys, so tasks write by pyarrow, to any path that it
    can open and all executors share. Files appear when all tasks are done, each
    task's once, however often it was tried. mode overwrite removes the directory's other Parquet
    files then. covering names a struct column (xmin, ymin, xmax, ymax) that holds
    each geometry's box, by which readers filter without looking at geometries.
    """
    import uuid

    if df.isEmpty():
        return False
    df.sparkSession.dataSource.register(GeoParquetSink)
    crs = df.schema[geometry].metadata.get("crs") or "EPSG:4326"
    options = {"geometry": geometry, "crs": crs, "job": uuid.uuid4().hex} | ({"covering": covering} if covering else {})
    df.write.format("geoparquet").options(**options).mode(mode).save(str(path))
    return True

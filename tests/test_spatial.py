import datetime
import glob
import json
import math
import os
import struct

import duckdb

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import parquet
from pyspark.sql import functions as F

from geolattice.functions import crs, geometry
from geolattice.functions.columns import has_source, overlaps, share_pct
from geolattice import FeatureStore, FileIndex, queries
from geolattice.functions.columns import with_position, with_running_sum
from geolattice.operators import analysis, inspection, retrieval
from geolattice.plans.cells import broadcast_pairs, cell_counts, tiled_pairs
from geolattice.sources import geoparquet, shapefile
from geolattice.streaming.boxes import stream_bbox


def point(x, y, order="<"):
    return struct.pack(order + "BIdd", order == "<", 1, x, y)


def polygon(*rings, order="<", code=3, size=2):
    data = struct.pack(order + "BII", order == "<", code, len(rings))
    for r in rings:
        data += struct.pack(order + "I", len(r)) + b"".join(struct.pack(f"{order}{size}d", *p, *[0.0] * (size - 2)) for p in r)
    return data


def rect(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def test_wkb_bounds_of_both_orders_and_headers():
    assert geometry.bounds_of(point(1, 2)) == geometry.bounds_of(point(1, 2, ">")) == (1, 2, 1, 2)
    assert geometry.bounds_of(polygon(rect(0, 0, 4, 3), code=1003, size=3)) == (0, 0, 4, 3)
    assert geometry.bounds_of(polygon(rect(0, 0, 4, 3), code=3 | 0x80000000, size=3)) == (0, 0, 4, 3)
    assert geometry.bounds_of(struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 5.0, 6.0)) == (5, 6, 5, 6)
    many = struct.pack("<BII", 1, 4, 2) + point(1, 5) + point(3, 2, ">")
    assert geometry.bounds_of(many) == (1, 2, 3, 5)
    assert geometry.bounds_of(None) is None and geometry.bounds_of(point(float("nan"), float("nan"))) is None
    with pytest.raises(ValueError):
        geometry.bounds_of(point(1, 2)[:-3])


def test_rectangle_test_knows_holes_edges_and_crossings():
    holed = polygon(rect(0, 0, 10, 10), rect(2, 2, 8, 8))
    assert not geometry.meets_box(holed, 3, 3, 4, 4)
    assert geometry.meets_box(holed, 1, 1, 1.5, 1.5)
    assert geometry.meets_box(holed, 10, 10, 12, 12) and not geometry.meets_box(holed, 10.1, 10.1, 12, 12)
    line = struct.pack("<BIIdddd", 1, 2, 2, -5.0, 5.0, 15.0, 5.0)
    assert geometry.meets_box(line, 0, 0, 10, 10) and not geometry.meets_box(line, 0, 6, 10, 10)
    triangle = polygon([(0, 0), (10, 0), (0, 10), (0, 0)])
    assert not geometry.meets_box(triangle, 8, 8, 9, 9)
    assert geometry.meets_box(point(1, 1), 1, 1, 1, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=8, max_size=8))
def test_rectangles_meet_as_the_four_inequalities_say(v):
    a, b = sorted(v[0:2]), sorted(v[2:4])
    c, d = sorted(v[4:6]), sorted(v[6:8])
    expected = a[1] >= c[0] and c[1] >= a[0] and b[1] >= d[0] and d[1] >= b[0]
    assert geometry.meets_box(polygon(rect(a[0], b[0], a[1], b[1])), c[0], d[0], c[1], d[1]) == expected


def test_has_source_is_never_null(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [(None,)]), (5, [(None,), ("OpenStreetMap",)]), (6, [("openstreetmap",)]), (7, [None, ("OpenStreetMap",)])]
    df = spark.createDataFrame(rows, "i int, s array<struct<dataset string>>")
    assert [r[0] for r in df.where(has_source("s", "OpenStreetMap")).orderBy("i").collect()] == [5, 7]
    assert df.where(has_source("s", "OpenStreetMap").isNull()).count() == 0


def test_share_is_null_for_zero(spark):
    df = spark.createDataFrame([(1, 4), (0, 0), (2, None)], "a long, b long").select(share_pct("a", "b"))
    assert [r[0] for r in df.collect()] == [25.0, None, None]


def test_tiled_plan_equals_broadcast_plan(spark):
    rng = np.random.default_rng(1)
    low = rng.uniform(-50, 50, (400, 2))
    size = rng.exponential(5, (400, 2)) * (rng.random((400, 1)) > 0.2)
    rows = [(i, *map(float, l), *map(float, l + s)) for i, (l, s) in enumerate(zip(low, size))] + [(999, 0.0, 0.0, 0.0, None), (998, 0.0, 0.0, float("nan"), 1.0), (997, 0.0, 0.0, float("inf"), 1.0), (996, -1e9, -1e9, 1e9, 1e9)]
    features = spark.createDataFrame(rows, "f long, minx double, miny double, maxx double, maxy double")
    cells = spark.createDataFrame([(k, float(k % 7 * 15 - 50), float(k // 7 * 15 - 50), float(k % 7 * 15 - 35), float(k // 7 * 15 - 35)) for k in range(49)] + [(100, -1e6, -1e6, 1e6, 1e6), (101, 3.0, 3.0, 3.0, 3.0), (102, 0.0, float("-inf"), 1.0, 1.0), (103, None, 0.0, 1.0, 1.0)], "cell long, cminx double, cminy double, cmaxx double, cmaxy double")
    one = sorted(map(tuple, broadcast_pairs(features, cells).select("f", "cell").collect()))
    assert len({c for _, c in one}) == 51 and not {997, 998, 999} & {f for f, _ in one}
    for tile in (1.0, 40.0, None):
        found = tiled_pairs(features, cells, tile)
        assert found.columns == broadcast_pairs(features, cells).columns
        assert sorted(map(tuple, found.select("f", "cell").collect())) == one
    counted = {plan: sorted(map(str, cell_counts(features, cells, plan=plan).collect())) for plan in ("broadcast", "tiled")}
    assert counted["broadcast"] == counted["tiled"] and len(counted["tiled"]) == 53
    assert tiled_pairs(features, cells.limit(0)).count() == 0 and tiled_pairs(features.limit(0), cells).count() == 0


def test_batches_equal_single_geometries(spark):
    rng = np.random.default_rng(3)
    shapes = [None, point(1, 2), point(float("nan"), 2), point(3, 4, ">"), polygon(rect(0, 0, 4, 3)), polygon(rect(0, 0, 9, 9), rect(2, 2, 8, 8)), polygon([(0, 0), (10, 0), (0, 10), (0, 0)]), polygon(rect(0, 0, 4, 3), code=1003, size=3), struct.pack("<BII", 1, 3, 0), struct.pack("<BII", 1, 7, 0), struct.pack("<BIIdddd", 1, 2, 2, -5.0, 5.0, 15.0, 5.0)]
    shapes = shapes * 30
    boxes = np.sort(rng.integers(-2, 12, (len(shapes), 2, 2)).astype(float), axis=1).reshape(-1, 4)
    for array in (pa.array(shapes, pa.binary()), pa.array([b"x"] + shapes, pa.binary()).slice(1), pa.array(shapes, pa.large_binary())):
        batch = geometry.Batch(array)
        expected = [geometry.bounds_of(x) for x in shapes]
        assert [None if np.isnan(b).any() else tuple(b) for b in batch.bounds()] == expected
        assert batch.meets(boxes).tolist() == [geometry.meets_box(x, *b) for x, b in zip(shapes, boxes)]
    df = spark.createDataFrame(list(enumerate(shapes)), "i int, g binary")
    empty = {r.i: r.e for r in df.select("i", geometry.st_is_empty("g").alias("e")).collect()}
    assert empty == {i: None if x is None else geometry.bounds_of(x) is None for i, x in enumerate(shapes)}
    assert geometry.Batch(pa.array([], pa.binary())).bounds().shape == (0, 4)


def test_places_and_running_sums_over_ranges(spark):
    rows = [(i, None if i % 5 == 0 else (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    got = with_position(df, F.col("v").asc_nulls_last(), "i")
    assert sorted((r.rank, r.i, r.v) for r in got.collect()) == [(k, *r) for k, r in enumerate(order)]
    sums = {r.i: r.total for r in with_running_sum(df, "v", "i").collect()}
    total = 0
    for i, v in rows:
        total += v or 0
        assert sums[i] == total
    assert with_position(df.limit(0), "i").count() == 0 and with_running_sum(df.limit(0), "v", "i").count() == 0
    assert with_position(df.withColumnRenamed("v", "at").withColumn("part", F.lit(1)), "i").columns == ["i", "at", "part", "rank"]
    numbers = retrieval.numbered(df.orderBy("i"), "place")
    assert sorted((r.i, r.place) for r in numbers.collect()) == [(i, i) for i in range(200)]


def write_geo(path, points, geo="auto", **more):
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table({"id": [f"f{i}" for i in range(len(points))], "geom": [point(*p) for p in points], "sources": pa.array([[{"dataset": "OpenStreetMap"}] if i % 2 else None for i in range(len(points))], pa.list_(pa.struct([("dataset", pa.string())])))})
    if geo == "auto":
        xs, ys = zip(*points)
        geo = json.dumps({"primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "bbox": [min(xs), min(ys), max(xs), max(ys)]}}})
    if geo is not None:
        table = table.replace_schema_metadata({"geo": geo})
    parquet.write_table(table, path)


@pytest.fixture
def store(spark, tmp_path):
    base = tmp_path / "data"
    write_geo(base / "a" / "1.parquet", [(0, 0), (1, 1), (2, 2)])
    write_geo(base / "b" / "2.parquet", [(10, 10), (11, 11)])
    write_geo(base / "3.parquet", [(50, 50)], geo=None)
    return FeatureStore(spark, base)


def test_retrieval(store):
    assert store.file_count == 2 and store.geometry_column == "geom"
    assert store.query_bbox(1, 1, 10, 10).count() == 3
    assert store.query_bbox(1, 1, 10, 10, columns=["id", "id"]).columns == ["id"]
    assert store.query_bbox(0, 0, 9, 9, columns=["upper(id) AS u"]).orderBy("u").first()[0] == "F0"
    assert len(store.index.candidates((0, 0, 3, 3))) == 1
    empty = store.query_bbox(90, 90, 91, 91)
    assert empty.count() == 0 and empty.columns == ["id", "geom", "sources"]
    assert store.query_bbox(0, 0, 20, 20, limit=2).count() == 2 and store.query_bbox(0, 0, 20, 20, limit=0).count() == 0
    assert [len(x) for x in store.iter_bbox(0, 0, 20, 20, chunk_size=2)] == [2, 2, 1]
    for bad in ((1, 0, 0, 1), (0, 1, 1, 0), (float("nan"), 0, 1, 1)):
        with pytest.raises(ValueError):
            store.query_bbox(*bad)
    with pytest.raises(ValueError):
        next(store.iter_bbox(0, 0, 1, 1, chunk_size=0))
    store.close()
    store.close()
    with pytest.raises(RuntimeError):
        store.query_bbox(0, 0, 1, 1)


def test_statistics_in_one_job_and_in_a_loop(spark, store):
    rows = [{"id": "x", "geometry": polygon(rect(0, 0, 1, 1))}, {"id": "none", "geometry": None}, {"id": "y", "geometry": polygon(rect(0, 0, 1, 1))}, {"id": "z", "geometry": polygon(rect(70, 70, 71, 71))}]
    for loop in (False, True):
        results, log = store.collect_bbox_statistics(rows, metadata_fields=["id", "absent"], loop=loop)
        assert results.columns == ["id", "absent", "geometry", "buildings_count", "osm_buildings_count"]
        assert sorted((r.id, r.buildings_count, r.osm_buildings_count) for r in results.collect()) == [("x", 2, 1), ("y", 2, 1), ("z", 0, 0)]
        assert log.columns == ["feature_index", "minx", "miny", "maxx", "maxy", "buildings_count", "candidate_file_count", "duration_seconds", "osm_buildings_count"]
        assert sorted((r.feature_index, r.candidate_file_count) for r in log.collect()) == [(0, 1), (2, 1), (3, 0)]
        assert all((r.duration_seconds is not None) == loop for r in log.collect())
    cells = spark.createDataFrame([(7, polygon(rect(0, 0, 20, 20)))], "n long, g binary")
    results, log = store.collect_bbox_statistics(cells, geometry_field="g", dataset=None)
    assert results.columns == ["geometry", "buildings_count"] and results.first().buildings_count == 5


@pytest.mark.parametrize("geo", ["{", "{}", '{"primary_column": "geom"}', '{"primary_column": "geom", "columns": {"geom": {"bbox": [0, 0, 0, 1, 1, 1]}}}', '{"primary_column": "other", "columns": {"other": {"bbox": [0, 0, 1, 1]}}}'])
def test_bad_footers_are_named(spark, tmp_path, geo):
    write_geo(tmp_path / "1.parquet", [(0, 0)])
    write_geo(tmp_path / "2.parquet", [(0, 0)], geo=geo)
    with pytest.raises(ValueError, match="2.parquet"):
        FeatureStore(spark, tmp_path)


def test_missing_and_empty_directories(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FeatureStore(spark, tmp_path / "absent")
    with pytest.raises(FileNotFoundError):
        FeatureStore(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        geoparquet.files_by_directory(spark, tmp_path)


def test_geoparquet_round_trip_and_crs(spark, tmp_path):
    df = spark.createDataFrame([(1, point(111319.49079327358, 0.0)), (2, None)], "id long, geometry binary")
    moved = crs.to_wgs84(crs.set_crs(df, "EPSG:3857"))
    assert crs.crs_of(moved) == "EPSG:4326"
    assert geoparquet.write(moved, tmp_path / "out") and not geoparquet.write(moved.limit(0), tmp_path / "none")
    assert not (tmp_path / "none").exists()
    back = geoparquet.read(spark, (tmp_path / "out").as_uri())
    assert crs.crs_of(back) == "EPSG:4326"
    found = {r.id: geometry.bounds_of(r.geometry) for r in back.collect()}
    assert found[2] is None and abs(found[1][0] - 1) < 1e-9 and abs(found[1][1]) < 1e-9
    with pytest.raises(RuntimeError):
        crs.to_wgs84(crs.set_crs(df, "EPSG:2056"))
    assert crs.crs_of(crs.to_wgs84(df)) == "EPSG:4326"


def test_shapefile(spark, tmp_path):
    shape = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)])
    body = struct.pack(">2i", 1, len(shape) // 2) + shape
    (tmp_path / "x.shp").write_bytes(b"\0" * 100 + body)
    fields = struct.pack("<11sc4xBB14x", b"id", b"C", 4, 0) + struct.pack("<11sc4xBB14x", b"entities", b"N", 6, 0)
    (tmp_path / "x.dbf").write_bytes(struct.pack("<4xIHH20x", 1, 32 + len(fields) + 1, 11) + fields + b"\r" + b" c1  " + b"    12")
    (tmp_path / "x.shx").write_bytes(b"\0" * 100 + struct.pack(">2i", 50, len(shape) // 2))
    (tmp_path / "x.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')
    df = shapefile.read(spark, str(tmp_path / "x.shp"))
    row = df.first()
    assert (row.id, row.entities, geometry.bounds_of(row.geometry)) == ("c1", 12, (0, 0, 1, 1))
    assert crs.crs_of(df) == "EPSG:4326"
    (tmp_path / "x.shx").unlink()
    assert shapefile.read(spark, str(tmp_path / "x.shp")).collect() == [row]
    (tmp_path / "x.cpg").write_text("ISO-8859-1")
    table = (tmp_path / "x.dbf").read_bytes()
    (tmp_path / "x.dbf").write_bytes(table[:-10] + b"\xe9t\xe9 " + table[-6:])
    assert shapefile.read(spark, str(tmp_path / "x.shp")).first().id == "été"


def test_shapes_of_all_kinds():
    points = lambda p: b"".join(struct.pack("<2d", *x) for x in p)
    with pytest.raises(ValueError):
        shapefile._wkb(struct.pack("<i4d3i", 31, 0, 0, 1, 1, 1, 5, 0) + points(rect(0, 0, 1, 1)))
    assert shapefile._wkb(struct.pack("<i", 0)) is None
    assert geometry.bounds_of(shapefile._wkb(struct.pack("<i4d", 11, 1, 2, 3, 4))) == (1, 2, 1, 2)
    assert geometry.bounds_of(shapefile._wkb(struct.pack("<i4di", 8, 0, 0, 0, 0, 2) + points([(1, 5), (3, 2)]))) == (1, 2, 3, 5)
    hole, far, outer = rect(2, 2, 4, 4), rect(20, 20, 30, 30)[::-1], rect(0, 0, 10, 10)[::-1]
    record = struct.pack("<i4d2i3i", 5, 0, 0, 0, 0, 3, 15, 0, 5, 10) + points(hole) + points(outer) + points(far)
    wkb = shapefile._wkb(record)
    assert not geometry.meets_box(wkb, 2.5, 2.5, 3, 3) and geometry.meets_box(wkb, 25, 25, 26, 26) and geometry.meets_box(wkb, 1, 1, 1, 1)


def test_inspection(spark, tmp_path):
    write_geo(tmp_path / "a" / "1.parquet", [(0, 0), (1, 1)])
    assert [(r.directory, r.n_files) for r in inspection.directories(spark, tmp_path).collect()] == [("a", 1)]
    assert inspection.sample(spark, tmp_path / "a" / "1.parquet", 1).count() == 1
    assert "primary_column" in inspection.geo_text(spark, tmp_path / "a" / "1.parquet")
    assert not inspection.write_csv(spark.range(0), str(tmp_path / "csv")) and inspection.write_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_overlap_counts_touching_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "minx double, miny double, maxx double, maxy double")
    assert df.where(overlaps("minx", "miny", "maxx", "maxy", (1, 1, 2, 2))).count() == 1
    assert df.where(overlaps("minx", "miny", "maxx", "maxy", (1.1, 1, 2, 2))).count() == 0
    assert df.select(F.lit(1)).count() == 1


def test_an_index_over_odd_files_and_a_kept_one(spark, tmp_path):
    write_geo(tmp_path / "1.parquet", [(0, 0)])
    write_geo(tmp_path / "2.parquet", [(0, 0)], geo="")
    write_geo(tmp_path / "_hidden" / "3.parquet", [(0, 0)])
    store = FeatureStore(spark, tmp_path)
    assert store.file_count == 1
    write_geo(tmp_path / "4.parquet", [(5, 5)])
    assert store.file_count == 1
    store.refresh()
    assert store.file_count == 2
    store.index.save(spark, str(tmp_path / "kept-index"))
    assert FileIndex.load(spark, str(tmp_path / "kept-index")) == store.index
    assert FeatureStore(spark, tmp_path.as_uri(), store.index).query_bbox(4, 4, 6, 6).count() == 1
    with pytest.raises(RuntimeError):
        geoparquet.scan(spark, str(tmp_path / "1.parquet")).limit(0).write.parquet(str(tmp_path / "empty"))
        geoparquet.scan(spark, str(tmp_path / "empty"), may_be_empty=False)


def test_what_is_written_opens_again(spark, tmp_path):
    rows = [(i, point(i, i) if i < 10 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, geometry binary").repartitionById(3, F.when(F.col("id") < 10, 0).otherwise(2))
    path = tmp_path / "out"
    assert geoparquet.write(df, path)
    store = FeatureStore(spark, path)
    assert store.file_count == 2 and sorted(e.bbox for e in store.index.entries if e.bbox) == [(0, 0, 9, 9)]
    assert store.query_bbox(3, 3, 5, 5).count() == 3 and spark.read.parquet(str(path)).count() == 20
    assert not [p for p in path.iterdir() if not p.name.startswith("part-")]
    assert geoparquet.write(df, path) and spark.read.parquet(str(path)).count() == 40
    assert geoparquet.write(df.where("id > 12"), path, mode="overwrite") and spark.read.parquet(str(path)).count() == 7
    only_nulls = FeatureStore(spark, path)
    assert only_nulls.query_bbox(0, 0, 99, 99).count() == 0 and only_nulls.index.candidates((0, 0, 99, 99)) == []


def test_a_task_that_failed_leaves_nothing(spark, tmp_path):
    raising = F.udf(lambda x: 1 // (x - 7), "long")
    df = spark.range(0, 20, 1, 2).select(raising("id").alias("id"), geometry.st_point(F.lit(1.0), F.lit(1.0)).alias("geometry"))
    with pytest.raises(Exception):
        df.sparkSession.dataSource.register(geoparquet.GeoParquetSink)
        df.write.format("geoparquet").options(geometry="geometry", crs="EPSG:4326", job="x").mode("append").save(str(tmp_path / "out"))
    assert not glob.glob(f"{tmp_path}/out/**/*.parquet", recursive=True)


def test_a_box_column_settles_rows_natively(spark, tmp_path):
    shapes = [polygon([(0, 0), (10, 0), (0, 10), (0, 0)]), polygon(rect(20, 20, 21, 21)), point(9, 9), None]
    box = F.struct(*(F.col(f"b.{b}").alias(n) for b, n in zip(("minx", "miny", "maxx", "maxy"), ("xmin", "ymin", "xmax", "ymax"))))
    df = spark.createDataFrame(list(enumerate(shapes)), "id long, geometry binary").withColumn("b", geometry.st_bounds("geometry"))
    df = df.withColumn("bbox", box).drop("b").coalesce(1)
    geoparquet.write(df, tmp_path / "out", covering="bbox")
    store = FeatureStore(spark, tmp_path / "out")
    assert store.index.covering == ("`bbox`.`xmin`", "`bbox`.`ymin`", "`bbox`.`xmax`", "`bbox`.`ymax`")
    found = store.query_bbox(8, 8, 30, 30, columns=["id"])
    assert sorted(r.id for r in found.collect()) == [1, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(bbox" in plan
    results, _ = store.collect_bbox_statistics([{"geometry": polygon(rect(8, 8, 30, 30))}, {"geometry": polygon(rect(-1, -1, 30, 30))}])
    assert sorted(r.buildings_count for r in results.collect()) == [2, 3]


class Shape:
    def __init__(self, bounds, wkb=None, is_empty=False):
        self.bounds, self.is_empty = bounds, is_empty
        if wkb:
            self.wkb = wkb


class Record:
    def __init__(self, **fields):
        self.__dict__.update(fields)


def test_statistics_of_frames_and_objects(spark, store):
    shapes = [Shape((0, 0, 1, 1), polygon(rect(0, 0, 1, 1))), None, Shape((0, 0, 0, 0), is_empty=True), Shape((9, 9, 12, 12))]
    frame = pd.DataFrame({"id": [1, 2, 3, 4.5], "when": pd.to_datetime(["2020-01-01", None, None, "2021-01-01"]), "mixed": ["a", 1, None, 2], "geometry": shapes}, index=[10, 11, 12, 13])
    results, log = store.collect_bbox_statistics(frame, metadata_fields=["id", "when", "mixed", "absent"])
    assert sorted(map(tuple, results.drop("geometry").collect())) == [(1.0, datetime.datetime(2020, 1, 1), "a", None, 2, 1), (4.5, datetime.datetime(2021, 1, 1), "2", None, 2, 1)]
    assert sorted(r.feature_index for r in log.collect()) == [10, 13]
    assert sorted(geometry.bounds_of(bytes(r.geometry)) for r in results.collect()) == [(0, 0, 1, 1), (9, 9, 12, 12)]
    named = store.collect_bbox_statistics(frame.set_index(pd.Index(["p", "q", "r", "s"])))[1]
    assert sorted(r.feature_index for r in named.collect()) == ["p", "s"]
    objects = [Record(geometry=shapes[0], id=np.int64(3)), Record(id=1), {"geometry": shapes[3], "id": 2.5}]
    results, log = store.collect_bbox_statistics(objects, metadata_fields=["id"])
    assert sorted(r.id for r in results.collect()) == [2.5, 3.0] and sorted(r.feature_index for r in log.collect()) == [0, 2]
    with pytest.raises(ValueError):
        store.collect_bbox_statistics([{"geometry": "POINT (1 1)"}])
    assert [x.count() for x in store.collect_bbox_statistics([])] == [0, 0]
    cells = spark.createDataFrame([(5, point(1, 1)), (6, None), (7, point(2, 2))], "place long, geometry binary").coalesce(1)
    assert sorted(r.feature_index for r in store.collect_bbox_statistics(cells)[1].collect()) == [0, 2]


def test_only_files_near_some_cell_are_read(spark, tmp_path):
    for k in range(6):
        write_geo(tmp_path / f"{k}.parquet", [(10 * k, 10 * k)])
    store = FeatureStore(spark, tmp_path)
    read = []
    scan = store._scan
    store._scan = lambda files: read.append(sorted(files)) or scan(files)
    store.collect_bbox_statistics([{"geometry": point(0, 0)}, {"geometry": point(50, 50)}])
    assert [[p.rpartition("/")[2] for p in files] for files in read] == [["0.parquet", "5.parquet"]]


def test_columns_with_blanks_and_expressions(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, point(0, 0))], "`my col` long, b long, geometry binary")
    geoparquet.write(df, tmp_path / "out")
    store = FeatureStore(spark, tmp_path / "out")
    assert store.query_bbox(0, 0, 1, 1, columns=["my col", "b + 1 AS c"]).collect() == [(1, 3)]


def test_rows_of_any_frame_that_meet_a_box(spark):
    df = spark.createDataFrame([(1, point(0, 0)), (2, None), (3, polygon(rect(0, 0, 5, 5)))], "id long, geometry binary")
    assert sorted(r.id for r in retrieval.where_meets(df, 0, 0, 1, 1).collect()) == [1, 3]
    with pytest.raises(RuntimeError):
        retrieval.where_meets(df, 50, 50, 51, 51)


def test_utm_goes_back_to_where_it_came_from(spark):
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    size = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]

    def forward(lon, lat, zone, south):
        e = math.sqrt(f * (2 - f))
        phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
        x = eta + sum(k * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, k in enumerate(alpha, 1))
        y = xi + sum(k * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, k in enumerate(alpha, 1))
        return 5e5 + size * x, size * y + 1e7 * south

    # the meridian's length up to 45 degrees, times the scale on it
    assert abs(forward(9, 45, 32, False)[1] - 0.9996 * 4984944.378) < 0.01
    for lon, lat, zone, south in ((8.7, 49.4, 32, False), (11.9, 70, 32, False), (-70.2, -33.4, 19, True), (9, 0, 32, False)):
        x, y = forward(lon, lat, zone, south)
        many = struct.pack("<BII", 1, 4, 1) + point(x, y, ">")
        df = spark.createDataFrame([(point(x, y),), (many,), (None,), (polygon(rect(x, y, x, y)),)], "geometry binary")
        moved = crs.to_wgs84(crs.set_crs(df, f"EPSG:32{7 if south else 6}{zone:02}"))
        for r in moved.where("geometry IS NOT NULL").collect():
            b = geometry.bounds_of(bytes(r.geometry))
            assert abs(b[0] - lon) < 1e-9 and abs(b[1] - lat) < 1e-9


def test_chart_and_generated_frames(spark):
    df = spark.createDataFrame([(1, 2, 3)], "cell long, a long, b long")
    assert sorted(map(tuple, analysis.series(df, "cell", "a", "b").collect())) == [(1, "a", 2.0), (1, "b", 3.0)]
    assert analysis.generated(spark, 5).count() == 5 and analysis.generated(spark, 0).count() == 0
    assert inspection.values(df, "a") == [(0, 2)]
    assert has_source  # a single struct counts as an array of one
    one = spark.createDataFrame([(("OpenStreetMap",),), (None,)], "s struct<dataset string>")
    assert [r[0] for r in one.select(has_source("s", "OpenStreetMap", single=True)).collect()] == [True, False]


def test_a_stream_of_files_is_filtered_as_it_grows(spark, tmp_path):
    write_geo(tmp_path / "in" / "1.parquet", [(0, 0), (5, 5)])
    rows = stream_bbox(spark, str(tmp_path / "in"), "id string, geom binary", "geom", (4, 4, 6, 6))
    query = rows.select("id").writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    write_geo(tmp_path / "in" / "2.parquet", [(4, 4)])
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.table("near").collect()) == ["f0", "f1"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, expected = queries.QUERIES[name](spark, base).toArrow(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(expected.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in sorted(t.column_names)))))
    assert rows(got) == rows(expected)

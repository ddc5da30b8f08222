"""The library's operators as queries over the synthetic tables, and their DuckDB SQL.

No table has geometry, so boxes come from numeric columns of lineitem and part, cells from a
range, and files of an index from groups of part. Queries named store_ write part's boxes as
GeoParquet into the shared folder and go through FeatureStore.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import crs
from .functions.columns import BOX, has_source, overlaps, with_running_sum
from .functions.geometry import st_bounds, st_is_empty, st_meets_box, st_point, st_rectangle
from .operators import inspection
from .operators.analysis import generated, map_frame, ranked, series, smallest, with_share
from .operators.inspection import describe, where_equal
from .operators.retrieval import FeatureStore, numbered, where_box_meets, where_meets
from .plans.cells import cell_counts
from .shared import new_path
from .sources import geoparquet

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TOUCH = (10, 2, 20, 4)


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _features(spark, sf_dir):
    """lineitem as boxes with a source array."""
    li = _read(spark, sf_dir, "lineitem")
    tag = lambda name: F.array(F.struct(F.lit(name).alias("dataset")))
    sources = F.when(F.col("l_returnflag") == "R", tag("OpenStreetMap")).when(F.col("l_returnflag") == "A", tag("Other"))
    return li.select(
        *KEYS,
        F.col("l_quantity").alias("minx"),
        (F.col("l_tax") * 100).alias("miny"),
        (F.col("l_quantity") + F.col("l_discount") * 20).alias("maxx"),
        (F.col("l_tax") * 100 + F.col("l_discount") * 10).alias("maxy"),
        sources.alias("sources"),
    )


def _cells(spark, low=0, high=2):
    x, y = F.col("id") % 6 * 10, F.floor(F.col("id") / 6) * high + low
    number = lambda c: c.cast("double")
    return spark.range(36).select(F.col("id").alias("cell"), number(x).alias("cminx"), number(y).alias("cminy"), number(x + 10).alias("cmaxx"), number(y + high).alias("cmaxy"))


def _in_box(spark, sf_dir, *box):
    return where_box_meets(_features(spark, sf_dir), *box)


def bbox_filter(spark, sf_dir):
    return _in_box(spark, sf_dir, *TOUCH).select(*KEYS, *BOX)


def bbox_touching(spark, sf_dir):
    return _in_box(spark, sf_dir, 50, 8, 60, 20).select(*KEYS, *BOX)


def bbox_degenerate(spark, sf_dir):
    return _in_box(spark, sf_dir, 25, 4, 25, 4).select(*KEYS, *BOX)


def bbox_project(spark, sf_dir):
    return _in_box(spark, sf_dir, *TOUCH).select(*dict.fromkeys([*KEYS, "minx", "minx"]))


def bbox_project_expr(spark, sf_dir):
    return _in_box(spark, sf_dir, *TOUCH).selectExpr(*KEYS, "minx * 2 AS minx2")


def bbox_limit_sorted(spark, sf_dir):
    return _in_box(spark, sf_dir, *TOUCH).select(*KEYS, "minx").orderBy(*KEYS).limit(50)


def bbox_empty(spark, sf_dir):
    return _in_box(spark, sf_dir, 1000, 1000, 1001, 1001).select(*KEYS, *BOX)


def page_k(spark, sf_dir):
    return _in_box(spark, sf_dir, *TOUCH).select(*KEYS, "minx").orderBy(*KEYS).offset(100).limit(25)


def has_source_counts(spark, sf_dir):
    tagged = has_source("sources", "OpenStreetMap")
    return _features(spark, sf_dir).groupBy(tagged.alias("tagged")).agg(F.count("*").alias("n"))


def _counted(spark, sf_dir, plan="broadcast"):
    features = _features(spark, sf_dir).select(*BOX, has_source("sources", "OpenStreetMap").alias("tagged"))
    counts = cell_counts(features, _cells(spark), 2.0, plan)
    return counts.withColumnsRenamed({"n": "buildings_count", "n_tagged": "osm_buildings_count"})


def cell_counts_all(spark, sf_dir):
    return _counted(spark, sf_dir).select("cell", "buildings_count")


def cell_counts_tagged(spark, sf_dir):
    return _counted(spark, sf_dir).select("cell", "buildings_count", "osm_buildings_count")


def cell_counts_zero(spark, sf_dir):
    return _counted(spark, sf_dir).where("buildings_count = 0").select("cell", "buildings_count")


def cell_counts_tiled(spark, sf_dir):
    return _counted(spark, sf_dir, "tiled").select("cell", "buildings_count", "osm_buildings_count")


def cell_share(spark, sf_dir):
    return with_share(_counted(spark, sf_dir)).select("cell", "osm_share_pct")


def cell_rank(spark, sf_dir):
    return ranked(with_share(_counted(spark, sf_dir)), "osm_share_pct", "cell").select("cell", "osm_share_pct", "rank")


def cell_top10(spark, sf_dir):
    return smallest(_counted(spark, sf_dir), "buildings_count", "cell").select("cell", "buildings_count", "osm_buildings_count")


def _files(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    return part.groupBy("p_brand", "p_type").agg(F.min(size).alias("minx"), F.min("p_retailprice").alias("miny"), F.max(size).alias("maxx"), F.max("p_retailprice").alias("maxy"))


def file_index_prune(spark, sf_dir):
    return _files(spark, sf_dir).where(overlaps(*BOX, (10, 920, 12, 930)))


def candidate_file_count(spark, sf_dir):
    counts = cell_counts(_files(spark, sf_dir).select(*BOX), _cells(spark, 900, 20), plan="broadcast")
    return counts.select("cell", F.col("n").alias("candidate_file_count"))


def eq_filter_sorted(spark, sf_dir):
    return where_equal(_read(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING", "c_custkey")


def _some_null(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return _read(spark, sf_dir, "customer").select("c_custkey", value.alias("v"))


def nulls_last_sort(spark, sf_dir):
    return ranked(_some_null(spark, sf_dir), "v", "c_custkey")


def skip_null_geometry(spark, sf_dir):
    return ranked(_some_null(spark, sf_dir), "c_custkey", name="feature_index").where("v IS NOT NULL")


def group_first(spark, sf_dir):
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


def running_total(spark, sf_dir):
    value = F.col("value").cast("decimal(18,2)")
    events = _read(spark, sf_dir, "events")
    return with_running_sum(events.select("event_id", value.alias("v")), "v", "event_id").select("event_id", F.col("total").cast("double").alias("total"))


def json_path(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _points(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", st_point(F.col("p_size").cast("double"), "p_retailprice").alias("geometry"))


def wkb_point_bbox(spark, sf_dir):
    box = [F.lit(float(x)) for x in (10, 920, 12, 930)]
    found = _points(spark, sf_dir).where(st_meets_box("geometry", *box))
    return found.withColumn("b", st_bounds("geometry")).select("p_partkey", F.col("b.minx").alias("x"), F.col("b.miny").alias("y"))


def frame_meets(spark, sf_dir):
    return where_meets(_points(spark, sf_dir), 10, 900, 30, 1000).select("p_partkey")


def describe_schema(spark, sf_dir):
    return describe(_read(spark, sf_dir, "lineitem"))


def _grid(spark):
    """1,024 cells, beyond what the broadcast plan takes."""
    x, y = F.col("id") % 32 * 2.0, F.floor(F.col("id") / 32) * 0.25
    return spark.range(1024).select(F.col("id").alias("cell"), x.alias("cminx"), y.alias("cminy"), (x + 2).alias("cmaxx"), (y + 0.25).alias("cmaxy"))


def cell_counts_many(spark, sf_dir):
    counts = cell_counts(_features(spark, sf_dir).select(*BOX), _grid(spark))
    return counts.select("cell", F.col("n").alias("buildings_count"))


def _parcels(spark, sf_dir):
    """part as rectangles with a source array and their boxes."""
    part = _read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    box = [size, F.col("p_retailprice"), size + 2, F.col("p_retailprice") + 10]
    sources = F.when(F.col("p_partkey") % 3 == 0, F.array(F.struct(F.lit("OpenStreetMap").alias("dataset"))))
    covering = F.struct(*(v.alias(n) for v, n in zip(box, ("xmin", "ymin", "xmax", "ymax"))))
    return part.select("p_partkey", "p_name", "p_size", sources.alias("sources"), covering.alias("bbox"), st_rectangle(*box).alias("geometry"))


def _dataset(spark, sf_dir, covering=None):
    """The rectangles as GeoParquet, a file for each ten sizes."""
    path = new_path(spark, "parcels")
    rows = _parcels(spark, sf_dir).repartitionById(5, F.least(F.lit(4), F.floor((F.col("p_size") - 1) / 10)).cast("int"))
    geoparquet.write(rows, path, covering=covering)
    return path


def _store(spark, sf_dir, covering=None):
    return FeatureStore(spark, _dataset(spark, sf_dir, covering))


PLACE = (10, 920, 12, 930)


def store_query_bbox(spark, sf_dir):
    return _store(spark, sf_dir).query_bbox(*PLACE, columns=["p_partkey", "p_size * 2 AS twice", "p_partkey"])


def store_query_covered(spark, sf_dir):
    return _store(spark, sf_dir, "bbox").query_bbox(*PLACE, columns=["p_partkey", "p_name"])


def store_query_empty(spark, sf_dir):
    return _store(spark, sf_dir).query_bbox(900, 0, 901, 1, columns=["p_partkey", "p_name"])


def store_query_limit(spark, sf_dir):
    return _store(spark, sf_dir).query_bbox(*PLACE, columns=["p_partkey"], limit=7).agg(F.count("*").alias("n"))


def store_iter_bbox(spark, sf_dir):
    import pandas as pd

    chunks = list(_store(spark, sf_dir).iter_bbox(*PLACE, chunk_size=10, columns=["p_partkey", "p_name"]))
    sizes = [n for k, c in enumerate(chunks) for n in [k] * len(c)]
    rows = pd.concat([*chunks, pd.DataFrame({"p_partkey": [], "p_name": []})])
    data = [(int(a), b) for a, b in zip(rows["p_partkey"], rows["p_name"])]
    full = all(sizes.count(k) == 10 for k in range(len(chunks) - 1))
    return spark.createDataFrame([(*r, full) for r in data], "p_partkey long, p_name string, full boolean")


def _areas(spark):
    """The cells of candidate_file_count as rectangles, one of them without a geometry."""
    shape = F.when(F.col("cell") != 7, st_rectangle("cminx", "cminy", "cmaxx", "cmaxy"))
    return _cells(spark, 900, 20).select("cell", F.concat(F.lit("c"), "cell").alias("id"), shape.alias("geometry"))


def _statistics(spark, sf_dir, rows, covering=None, **options):
    return _store(spark, sf_dir, covering).collect_bbox_statistics(rows, metadata_fields=["id"], **options)


def store_results(spark, sf_dir):
    return _statistics(spark, sf_dir, _areas(spark), index_field="cell")[0].select("id", "buildings_count", "osm_buildings_count")


def store_log(spark, sf_dir):
    return _statistics(spark, sf_dir, _areas(spark), "bbox", index_field="cell")[1].drop("duration_seconds")


def store_from_pandas(spark, sf_dir):
    frame = _areas(spark).orderBy("cell").toPandas().set_index("cell")
    results, log = _statistics(spark, sf_dir, frame, "bbox")
    counts = log.select("feature_index", F.col("buildings_count").alias("logged"))
    return results.join(counts, results.id == F.concat(F.lit("c"), "feature_index")).select("id", "feature_index", "buildings_count", "osm_buildings_count", "logged")


def store_loop(spark, sf_dir):
    rows = [r.asDict() for r in _areas(spark).where("cell IN (0, 7, 8)").orderBy("cell").collect()]
    results, log = _statistics(spark, sf_dir, rows, loop=True)
    timed = log.select(F.every(F.col("duration_seconds") > 0).alias("timed"))
    return results.select("id", "buildings_count", "osm_buildings_count").join(timed)


def file_index(spark, sf_dir):
    return _store(spark, sf_dir).index.frame(spark).select(*BOX)


def file_index_saved(spark, sf_dir):
    store, path = _store(spark, sf_dir), new_path(spark, "index")
    store.index.save(spark, path)
    again = FeatureStore(spark, store.base_path, geoparquet.FileIndex.load(spark, path))
    return again.query_bbox(*PLACE, columns=["p_partkey"])


def footer_json(spark, sf_dir):
    paths = geoparquet.list_files(spark, _dataset(spark, sf_dir))
    rows = spark.createDataFrame([(x,) for x in geoparquet.footers(spark, paths, "geo")], "geo string")
    side = lambda k: F.get_json_object("geo", f"$.columns.geometry.bbox[{k}]").cast("double")
    return rows.select(F.get_json_object("geo", "$.primary_column").alias("primary_column"), *(side(k).alias(b) for k, b in enumerate(BOX)))


def geo_round_trip(spark, sf_dir):
    rows = geoparquet.read(spark, _dataset(spark, sf_dir)).withColumn("b", st_bounds("geometry"))
    return rows.select("p_partkey", "b.*", F.lit(crs.crs_of(rows)).alias("crs"))


def directory_counts(spark, sf_dir):
    path = new_path(spark, "by_size")
    _read(spark, sf_dir, "part").coalesce(1).write.partitionBy("p_size").parquet(path)
    return inspection.directories(spark, path).select("directory", "n_files")


def glob_scan(spark, sf_dir):
    path = new_path(spark, "glob")
    _read(spark, sf_dir, "supplier").repartition(3).write.parquet(path)
    return geoparquet.scan(spark, f"{path}/*.parquet", may_be_empty=False)


def sample_rows(spark, sf_dir):
    return inspection.sample(spark, f"{sf_dir}/nation.parquet").agg(F.count("*").alias("n"))


def export_parquet(spark, sf_dir):
    path = new_path(spark, "export")
    inspection.export(where_equal(_parcels(spark, sf_dir), "p_size", 7, "p_partkey"), path, "geometry")
    return FeatureStore(spark, path).query_bbox(0, 0, 1e6, 1e6, columns=["p_partkey", "p_name"])


def export_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    inspection.write_csv(rows, path)
    return spark.read.schema("s_suppkey long, s_name string").option("header", True).csv(path)


def polygon_bbox(spark, sf_dir):
    features = _features(spark, sf_dir)
    box = [F.lit(float(x)) for x in TOUCH]
    return features.where(st_meets_box(st_rectangle(*BOX), *box)).select(*KEYS)


def wkb_bounds(spark, sf_dir):
    return _parcels(spark, sf_dir).withColumn("b", st_bounds("geometry")).select("p_partkey", "b.*")


def geometry_empty(spark, sf_dir):
    nothing = F.lit(float("nan"))
    x = F.when(F.col("p_partkey") % 3 == 0, nothing).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("double"))
    shapes = _read(spark, sf_dir, "part").select("p_partkey", st_point(x, F.lit(1.0)).alias("g"))
    return shapes.select("p_partkey", st_is_empty("g").alias("empty"))


def _projected(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 1000).alias("px"), (F.col("p_size") * 100000.0).alias("py")).withColumn("geometry", st_point("px", "py"))


def mercator_to_wgs84(spark, sf_dir):
    moved = crs.to_wgs84(crs.set_crs(_projected(spark, sf_dir), "EPSG:3857")).withColumn("b", st_bounds("geometry"))
    return moved.select("p_partkey", F.round("b.minx", 8).alias("lon"), F.round("b.miny", 8).alias("lat"))


def utm_axis_to_wgs84(spark, sf_dir):
    rows = _projected(spark, sf_dir).withColumn("geometry", st_point(F.lit(5e5), F.lit(0.0)))
    moved = crs.to_wgs84(crs.set_crs(rows, "EPSG:32632")).withColumn("b", st_bounds("geometry"))
    return moved.select("p_partkey", F.round("b.minx", 8).alias("lon"), F.round("b.miny", 8).alias("lat"))


def generated_frame(spark, sf_dir):
    return generated(spark, 10, 5).select("x", F.col("y").isNotNull().alias("has_y"))


def row_counts(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    rows = [("all", nation.count(), nation.isEmpty()), ("none", nation.where("n_nationkey < 0").count(), nation.where("n_nationkey < 0").isEmpty())]
    return spark.createDataFrame(rows, "name string, n long, empty boolean")


def row_numbers(spark, sf_dir):
    ordered = _read(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey")
    return numbered(ordered, "feature_index")


def chart_series(spark, sf_dir):
    return series(_counted(spark, sf_dir), "cell", "buildings_count", "osm_buildings_count")


def map_rows(spark, sf_dir):
    shapes = _areas(spark)
    return map_frame(shapes, "geometry", "id").select("id", st_bounds("geometry").alias("b")).select("id", "b.*")


def has_source_single(spark, sf_dir):
    one = F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit("OpenStreetMap").alias("dataset")))
    return _read(spark, sf_dir, "part").select("p_partkey", has_source(one, "OpenStreetMap", single=True).alias("tagged"))


QUERIES = {
    "bbox_filter": bbox_filter,
    "bbox_touching": bbox_touching,
    "bbox_degenerate": bbox_degenerate,
    "bbox_project": bbox_project,
    "bbox_project_expr": bbox_project_expr,
    "bbox_limit_sorted": bbox_limit_sorted,
    "bbox_empty": bbox_empty,
    "page_k": page_k,
    "has_source": has_source_counts,
    "cell_counts": cell_counts_all,
    "cell_counts_tagged": cell_counts_tagged,
    "cell_counts_zero": cell_counts_zero,
    "cell_counts_tiled": cell_counts_tiled,
    "cell_share": cell_share,
    "cell_rank": cell_rank,
    "cell_top10": cell_top10,
    "file_index_prune": file_index_prune,
    "candidate_file_count": candidate_file_count,
    "eq_filter_sorted": eq_filter_sorted,
    "nulls_last_sort": nulls_last_sort,
    "skip_null_geometry": skip_null_geometry,
    "group_first": group_first,
    "running_sum": running_total,
    "json_path": json_path,
    "wkb_point_bbox": wkb_point_bbox,
    "describe_schema": describe_schema,
    "frame_meets": frame_meets,
    "cell_counts_many": cell_counts_many,
    "store_query_bbox": store_query_bbox,
    "store_query_covered": store_query_covered,
    "store_query_empty": store_query_empty,
    "store_query_limit": store_query_limit,
    "store_iter_bbox": store_iter_bbox,
    "store_results": store_results,
    "store_log": store_log,
    "store_from_pandas": store_from_pandas,
    "store_loop": store_loop,
    "file_index": file_index,
    "file_index_saved": file_index_saved,
    "footer_json": footer_json,
    "geo_round_trip": geo_round_trip,
    "directory_counts": directory_counts,
    "glob_scan": glob_scan,
    "sample_rows": sample_rows,
    "export_parquet": export_parquet,
    "export_csv": export_csv,
    "polygon_bbox": polygon_bbox,
    "wkb_bounds": wkb_bounds,
    "geometry_empty": geometry_empty,
    "mercator_to_wgs84": mercator_to_wgs84,
    "utm_axis_to_wgs84": utm_axis_to_wgs84,
    "generated_frame": generated_frame,
    "row_counts": row_counts,
    "row_numbers": row_numbers,
    "chart_series": chart_series,
    "map_rows": map_rows,
    "has_source_single": has_source_single,
}

_F = """WITH f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS minx, l_tax * 100 AS miny,
         l_quantity + l_discount * 20 AS maxx, l_tax * 100 + l_discount * 10 AS maxy,
         CASE l_returnflag WHEN 'R' THEN [{'dataset': 'OpenStreetMap'}] WHEN 'A' THEN [{'dataset': 'Other'}] END AS sources
  FROM lineitem)"""
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_HAS = "coalesce(len(list_filter(sources, lambda x: x.dataset = 'OpenStreetMap')) > 0, false)"
_CELLS = """c AS (SELECT range AS cell, CAST(range % 6 * 10 AS DOUBLE) AS cx, CAST(range // 6 * {h} + {l} AS DOUBLE) AS cy FROM range(36))"""
_ON = "maxx >= cx AND cx + 10 >= minx AND maxy >= cy AND cy + {h} >= miny"
_COUNTS = f"""{_F}, {_CELLS.format(h=2, l=0)},
n AS (SELECT cell, CAST(count(minx) AS BIGINT) AS buildings_count,
             CAST(count(*) FILTER (minx IS NOT NULL AND {_HAS}) AS BIGINT) AS osm_buildings_count
      FROM c LEFT JOIN f ON {_ON.format(h=2)} GROUP BY cell)"""
_SHARE = f"{_COUNTS}, s AS (SELECT cell, CAST(osm_buildings_count AS DOUBLE) / nullif(CAST(buildings_count AS DOUBLE), 0) * 100 AS osm_share_pct FROM n)"
_FILES = """files AS (SELECT p_brand, p_type, min(CAST(p_size AS DOUBLE)) AS minx, min(p_retailprice) AS miny,
                  max(CAST(p_size AS DOUBLE)) AS maxx, max(p_retailprice) AS maxy
                  FROM part GROUP BY p_brand, p_type)"""
_NULLS = "v AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v FROM customer)"

_GRID = "c AS (SELECT range AS cell, range % 32 * 2.0::DOUBLE AS cx, (range // 32) * 0.25::DOUBLE AS cy FROM range(1024))"
_P = """p AS (SELECT p_partkey, p_name, p_size, CAST(p_size AS DOUBLE) AS minx, p_retailprice AS miny, CAST(p_size AS DOUBLE) + 2 AS maxx,
  p_retailprice + 10 AS maxy, p_partkey % 3 = 0 AS tagged FROM part),
files AS (SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM p GROUP BY least(4, (p_size - 1) // 10))"""
_AREAS = f"""{_P}, {_CELLS.format(h=20, l=900)}, a AS (SELECT * FROM c WHERE cell <> 7),
n AS (SELECT cell, CAST(count(p.minx) AS BIGINT) AS buildings_count, CAST(count(*) FILTER (tagged) AS BIGINT) AS osm_buildings_count
      FROM a LEFT JOIN p ON {_ON.format(h=20)} GROUP BY cell),
k AS (SELECT cell, CAST(count(files.minx) AS BIGINT) AS candidate_file_count FROM a LEFT JOIN files ON {_ON.format(h=20)} GROUP BY cell)"""
_NAMED = "'c' || cell AS id"


def _where(minx, miny, maxx, maxy):
    return f"maxx >= {minx} AND minx <= {maxx} AND maxy >= {miny} AND miny <= {maxy}"


ORACLE_SQL = {
    "bbox_filter": f"{_F} SELECT {_K}, minx, miny, maxx, maxy FROM f WHERE {_where(*TOUCH)}",
    "bbox_touching": f"{_F} SELECT {_K}, minx, miny, maxx, maxy FROM f WHERE {_where(50, 8, 60, 20)}",
    "bbox_degenerate": f"{_F} SELECT {_K}, minx, miny, maxx, maxy FROM f WHERE {_where(25, 4, 25, 4)}",
    "bbox_project": f"{_F} SELECT {_K}, minx FROM f WHERE {_where(*TOUCH)}",
    "bbox_project_expr": f"{_F} SELECT {_K}, minx * 2 AS minx2 FROM f WHERE {_where(*TOUCH)}",
    "bbox_limit_sorted": f"{_F} SELECT {_K}, minx FROM f WHERE {_where(*TOUCH)} ORDER BY {_K} LIMIT 50",
    "bbox_empty": f"{_F} SELECT {_K}, minx, miny, maxx, maxy FROM f WHERE {_where(1000, 1000, 1001, 1001)}",
    "page_k": f"{_F} SELECT {_K}, minx FROM f WHERE {_where(*TOUCH)} ORDER BY {_K} LIMIT 25 OFFSET 100",
    "has_source": f"{_F} SELECT {_HAS} AS tagged, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1",
    "cell_counts": f"{_COUNTS} SELECT cell, buildings_count FROM n",
    "cell_counts_tagged": f"{_COUNTS} SELECT cell, buildings_count, osm_buildings_count FROM n",
    "cell_counts_zero": f"{_COUNTS} SELECT cell, buildings_count FROM n WHERE buildings_count = 0",
    "cell_counts_tiled": f"{_COUNTS} SELECT cell, buildings_count, osm_buildings_count FROM n",
    "cell_share": f"{_SHARE} SELECT cell, osm_share_pct FROM s",
    "cell_rank": f"{_SHARE} SELECT cell, osm_share_pct, CAST(row_number() OVER (ORDER BY osm_share_pct NULLS LAST, cell) - 1 AS BIGINT) AS rank FROM s",
    "cell_top10": f"{_COUNTS} SELECT cell, buildings_count, osm_buildings_count FROM n ORDER BY buildings_count NULLS LAST, cell LIMIT 10",
    "file_index_prune": f"WITH {_FILES} SELECT * FROM files WHERE {_where(10, 920, 12, 930)}",
    "candidate_file_count": f"WITH {_FILES}, {_CELLS.format(h=20, l=900)} SELECT cell, CAST(count(minx) AS BIGINT) AS candidate_file_count FROM c LEFT JOIN files ON {_ON.format(h=20)} GROUP BY cell",
    "eq_filter_sorted": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey",
    "nulls_last_sort": f"WITH {_NULLS} SELECT c_custkey, v, CAST(row_number() OVER (ORDER BY v NULLS LAST, c_custkey) - 1 AS BIGINT) AS rank FROM v",
    "skip_null_geometry": f"WITH {_NULLS}, r AS (SELECT c_custkey, v, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS feature_index FROM v) SELECT * FROM r WHERE v IS NOT NULL",
    "group_first": "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, min(p_name) AS first_name FROM part GROUP BY p_brand",
    "running_sum": "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events",
    "json_path": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "wkb_point_bbox": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice BETWEEN 920 AND 930",
    "describe_schema": """SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS column_type,
  "null", CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS "default", CAST(NULL AS VARCHAR) AS extra FROM (DESCRIBE SELECT * FROM lineitem)""",
    "frame_meets": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 900 AND 1000",
    "cell_counts_many": f"{_F}, {_GRID} SELECT cell, CAST(count(minx) AS BIGINT) AS buildings_count FROM c LEFT JOIN f ON maxx >= cx AND cx + 2 >= minx AND maxy >= cy AND cy + 0.25 >= miny GROUP BY cell",
    "store_query_bbox": f"WITH {_P} SELECT p_partkey, p_size * 2 AS twice FROM p WHERE {_where(*PLACE)}",
    "store_query_covered": f"WITH {_P} SELECT p_partkey, p_name FROM p WHERE {_where(*PLACE)}",
    "store_query_empty": f"WITH {_P} SELECT p_partkey, p_name FROM p WHERE {_where(900, 0, 901, 1)}",
    "store_query_limit": f"WITH {_P} SELECT CAST(least(7, count(*)) AS BIGINT) AS n FROM p WHERE {_where(*PLACE)}",
    "store_iter_bbox": f"WITH {_P} SELECT p_partkey, p_name, true AS full FROM p WHERE {_where(*PLACE)}",
    "store_results": f"WITH {_AREAS} SELECT {_NAMED}, buildings_count, osm_buildings_count FROM n",
    "store_log": f"WITH {_AREAS} SELECT cell AS feature_index, cx AS minx, cy AS miny, cx + 10 AS maxx, cy + 20 AS maxy, buildings_count, candidate_file_count, osm_buildings_count FROM a JOIN n USING (cell) JOIN k USING (cell)",
    "store_from_pandas": f"WITH {_AREAS} SELECT {_NAMED}, cell AS feature_index, buildings_count, osm_buildings_count, buildings_count AS logged FROM n",
    "store_loop": f"WITH {_AREAS} SELECT {_NAMED}, buildings_count, osm_buildings_count, true AS timed FROM n WHERE cell IN (0, 8)",
    "file_index": f"WITH {_P} SELECT * FROM files",
    "file_index_saved": f"WITH {_P} SELECT p_partkey FROM p WHERE {_where(*PLACE)}",
    "footer_json": f"WITH {_P} SELECT 'geometry' AS primary_column, * FROM files",
    "geo_round_trip": f"WITH {_P} SELECT p_partkey, minx, miny, maxx, maxy, 'EPSG:4326' AS crs FROM p",
    "directory_counts": "SELECT 'p_size=' || p_size AS directory, CAST(1 AS BIGINT) AS n_files FROM part GROUP BY p_size",
    "glob_scan": "SELECT * FROM supplier",
    "sample_rows": "SELECT CAST(least(5, count(*)) AS BIGINT) AS n FROM nation",
    "export_parquet": "SELECT p_partkey, p_name FROM part WHERE p_size = 7",
    "export_csv": "SELECT s_suppkey, s_name FROM supplier",
    "polygon_bbox": f"{_F} SELECT {_K} FROM f WHERE {_where(*TOUCH)}",
    "wkb_bounds": f"WITH {_P} SELECT p_partkey, minx, miny, maxx, maxy FROM p",
    "geometry_empty": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS empty FROM part",
    "mercator_to_wgs84": "SELECT p_partkey, round(degrees(p_retailprice * 1000 / 6378137.0), 8) AS lon, round(degrees(2 * atan(exp(p_size * 100000.0::DOUBLE / 6378137.0)) - pi() / 2), 8) AS lat FROM part",
    "utm_axis_to_wgs84": "SELECT p_partkey, 9.0::DOUBLE AS lon, 0.0::DOUBLE AS lat FROM part",
    "generated_frame": "SELECT range AS x, true AS has_y FROM range(10)",
    "row_counts": "SELECT 'all' AS name, CAST(count(*) AS BIGINT) AS n, count(*) = 0 AS empty FROM nation UNION ALL SELECT 'none', CAST(count(*) AS BIGINT), count(*) = 0 FROM nation WHERE n_nationkey < 0",
    "row_numbers": "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS feature_index FROM customer",
    "chart_series": f"{_COUNTS} SELECT cell, 'buildings_count' AS name, CAST(buildings_count AS DOUBLE) AS value FROM n UNION ALL SELECT cell, 'osm_buildings_count', CAST(osm_buildings_count AS DOUBLE) FROM n",
    "map_rows": f"WITH {_AREAS} SELECT {_NAMED}, cx AS minx, cy AS miny, cx + 10 AS maxx, cy + 20 AS maxy FROM a",
    "has_source_single": "SELECT p_partkey, p_partkey % 3 = 0 AS tagged FROM part",
}

"""Box retrieval from a directory to which files are still being added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import st_meets_box
from ..sources.geoparquet import check_box


def stream_bbox(spark: SparkSession, path: str, schema, geometry: str, box) -> DataFrame:
    """A stream of the features in files under path whose geometry meets the box."""
    box = check_box(*box)
    return spark.readStream.schema(schema).parquet(path).where(st_meets_box(F.col(geometry), *(F.lit(x) for x in box)))

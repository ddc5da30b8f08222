"""Looking at datasets: files by directory, schema, samples, footers, filtered export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import geoparquet
from ..sources.geoparquet import directory_label, footer, list_files


def directories(spark: SparkSession, base) -> DataFrame:
    """directory, n_files, first_file, in order; none at all is an error."""
    paths = list_files(spark, base)
    if not paths:
        raise FileNotFoundError(f"No Parquet files below {base}")
    rows = spark.createDataFrame([(directory_label(spark, p, base), p) for p in paths], "directory string, path string")
    return rows.groupBy("directory").agg(F.count("*").alias("n_files"), F.min("path").alias("first_file")).orderBy("directory")


def describe(df: DataFrame) -> DataFrame:
    """column_name, column_type, null, key, default, extra: the schema as rows; types as Spark spells them, the last three always null."""
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", None, None, None) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, `null` string, key string, `default` string, extra string")


def sample(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """Any n rows of a file."""
    return spark.sql("SELECT * FROM parquet.`" + str(path).replace("`", "``") + "` LIMIT :n", args={"n": n})


def values(df: DataFrame, column: str, n: int = 5) -> list:
    """(place, value) of a column in any n rows."""
    return list(enumerate(r[0] for r in df.select(F.col(f"`{column}`")).limit(n).collect()))


def geo_text(spark: SparkSession, path) -> str:
    """The geo footer, indented; a message where it is absent or no JSON."""
    text = footer(spark, path).get("geo")
    if text is None:
        return "no geo footer"
    try:
        return json.dumps(json.loads(text), indent=2)
    except ValueError as error:
        return f"the geo footer is no JSON: {error}"


def where_equal(df: DataFrame, column: str, value, order: str) -> DataFrame:
    """Rows with the value, in order, nulls last."""
    return df.where(F.col(column) == value).orderBy(F.col(order).asc_nulls_last())


def write_csv(df: DataFrame, path: str) -> bool:
    """One CSV file with a header in directory path; nothing for an empty df."""
    if df.isEmpty():
        return False
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def export(df: DataFrame, path: str, geometry: str | None = None) -> bool:
    """df as Parquet in directory path, in place of what is there, with a geo footer if geometry names a column; nothing for an empty df."""
    if geometry is not None:
        return geoparquet.write(df, path, geometry, "overwrite")
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True

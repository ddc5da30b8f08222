"""Shares and rankings of counts for cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import share_pct, with_position, with_running_sum


def with_share(counts: DataFrame, part: str = "osm_buildings_count", whole: str = "buildings_count", name: str = "osm_share_pct") -> DataFrame:
    """counts with part as a share of whole in percent; null where whole is 0."""
    return counts.withColumn(name, share_pct(part, whole))


def ranked(df: DataFrame, by: str, *ties: str, name: str = "rank") -> DataFrame:
    """df with each row's place by a column, nulls last, from 0."""
    return with_position(df, F.col(by).asc_nulls_last(), *ties, name=name)


def smallest(df: DataFrame, by: str, *ties: str, n: int = 10) -> DataFrame:
    """The first n rows by a column, nulls last."""
    return df.orderBy(F.col(by).asc_nulls_last(), *ties).limit(n)


def series(df: DataFrame, x: str, *names: str) -> DataFrame:
    """x, name, value: the given columns one below the other, as line and bar charts take them."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))
    return df.select(x, F.explode(pairs).alias("p")).select(x, "p.*")


def map_frame(df: DataFrame, geometry: str = "geometry", *tooltip: str) -> DataFrame:
    """The geometry and the fields that a map shows beside it; rows without a geometry go."""
    return df.where(F.col(geometry).isNotNull()).select(*dict.fromkeys([*tooltip, geometry]))


def generated(spark, n: int = 10, seed: int = 0) -> DataFrame:
    """x from 0 to n - 1 and y, the running sum of normal random numbers."""
    rows = spark.range(n).select(F.col("id").alias("x"), F.randn(seed).alias("step"))
    return with_running_sum(rows, "step", "x", name="y").select("x", "y")

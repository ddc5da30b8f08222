"""Box overlap, source tags, shares, places and running sums. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, fresh

BOX = ("minx", "miny", "maxx", "maxy")


def overlaps(minx, miny, maxx, maxy, other) -> Column:
    """Whether two closed boxes share a point; touching edges do. other: four columns or numbers."""
    a, b, c, d = (x if isinstance(x, Column) else F.lit(float(x)) for x in other)
    minx, miny, maxx, maxy = (F.col(x) if isinstance(x, str) else x for x in (minx, miny, maxx, maxy))
    return (maxx >= a) & (c >= minx) & (maxy >= b) & (d >= miny)


def finite(*sides) -> Column:
    """Whether all sides of a box are there and finite; never null."""
    sides = [F.col(x) if isinstance(x, str) else x for x in sides]
    # a comparison with a NaN, which is above all numbers, says no
    good = [F.abs(x) < F.lit(float("inf")) for x in sides]
    out = good[0]
    for g in good[1:]:
        out = out & g
    return F.coalesce(out, F.lit(False))


def has_source(sources, dataset: str, single: bool = False) -> Column:
    """Whether any element's dataset equals the name; null arrays, elements and names say no, never null.

    With single, sources is one struct or map, which counts as an array of one.
    """
    sources = F.col(sources) if isinstance(sources, str) else sources
    sources = F.array(sources) if single else sources
    return F.coalesce(F.exists(sources, lambda s: F.coalesce(s["dataset"] == dataset, F.lit(False))), F.lit(False))


def share_pct(part, whole) -> Column:
    """part / whole * 100 as a double, null where whole is 0 or null."""
    whole = F.col(whole) if isinstance(whole, str) else whole
    part = F.col(part) if isinstance(part, str) else part
    return F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0)).cast("double")) * 100


def _in_order(df: DataFrame, order, name: str) -> tuple[DataFrame, str, str]:
    """df dealt out by ranges of the order and kept so: part is a range's number, at a row's place in it, from 0."""
    part, at = fresh([*df.columns, name], "part", "at")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    kept = cut(dealt)
    return kept.withColumn(part, F.shiftrightunsigned(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), part, at


def _before(parts: DataFrame, part: str, total: str) -> DataFrame:
    """part and before, the sum of the totals of smaller parts; there are as many rows as ranges."""
    from pyspark.sql import Window

    before = F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(parts.select(F.col(part), F.coalesce(before, F.lit(0)).alias("before")))


def with_position(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with each row's place in the given order, from 0, as a long. Each task sorts a range of rows; only their numbers are added up."""
    order = [F.col(x) if isinstance(x, str) else x for x in order]
    kept, part, at = _in_order(df, order, name)
    (before,) = fresh([*kept.columns, name], "before")
    offsets = _before(kept.groupBy(part).agg(F.count("*").alias("rows")), part, "rows").withColumnRenamed("before", before)
    return kept.join(offsets, part).withColumn(name, F.col(before) + F.col(at)).select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()), name)


def with_running_sum(df: DataFrame, value, *order, name: str = "total") -> DataFrame:
    """df with the sum of value over all rows up to each in the given order; null values add nothing, and before the first other it is 0. Ranges are summed each on its own, then shifted."""
    from pyspark.sql import Window

    order = [F.col(x) if isinstance(x, str) else x for x in order]
    (held,) = fresh([*df.columns, name], "value")
    kept, part, at = _in_order(df.withColumn(held, value if isinstance(value, Column) else F.col(value)), order, name)
    (before,) = fresh([*kept.columns, name], "before")
    offsets = _before(kept.groupBy(part).agg(F.sum(held).alias("sums")), part, "sums").withColumnRenamed("before", before)
    within = F.sum(held).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = kept.withColumn(name, within).join(offsets, part)
    return summed.withColumn(name, F.coalesce(name, F.lit(0)) + F.col(before)).select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()), name)

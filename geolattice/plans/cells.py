"""Counting features for each cell in one distributed job.

features: minx, miny, maxx, maxy and optionally tagged (boolean); cells: cell and
cminx, cminy, cmaxx, cmaxy. Every cell is in the result, with 0 if nothing meets it.
Boxes with a side that is null, NaN or infinite meet nothing, by either plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BOX, finite, overlaps
from ..shared import fresh

CELL_BOX = ("cminx", "cminy", "cmaxx", "cmaxy")
#: Up to so many cells the broadcast plan is used (about 50 bytes each); by measurement the tiles win from there on.
BROADCAST_CELLS = 500


def _counts(pairs: DataFrame) -> DataFrame:
    tagged = F.count_if("tagged") if "tagged" in pairs.columns else F.lit(None).cast("long")
    return pairs.groupBy("cell").agg(F.count("*").alias("n"), tagged.alias("n_tagged"))


def _all_cells(cells: DataFrame, counts: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return cells.join(counts, "cell", "left").select(*cells.columns, zero("n"), zero("n_tagged"))


def broadcast_pairs(features: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs that overlap, the cells sent to every task: for few cells."""
    cells = F.broadcast(cells.where(finite(*CELL_BOX)))
    return features.where(finite(*BOX)).join(cells, overlaps(*BOX, [F.col(c) for c in CELL_BOX]))


def tiled_pairs(features: DataFrame, cells: DataFrame, tile: float | None = None) -> DataFrame:
    """The same pairs through an equi-join on tiles, with no limit on either side.

    Features outside the extent of all cells go, others are cut to it. A box belongs to the
    level whose tiles, tile * 2**level wide, are at least as large as it is, so it lies in four
    tiles at most, there and at every higher level. A pair meets at the higher of its two levels: features are
    also dealt out at the higher levels that cells have, cells at all higher ones that a
    feature can have, whose number is the logarithm of the extent in tiles. A pair counts in
    the tile of the larger of its two lower corners only. One pass over the cells finds extent and levels; tile is their mean size by default.
    """
    cells = cells.where(finite(*CELL_BOX))
    size_of = lambda a, b, c, d: F.greatest(F.col(c) - F.col(a), F.col(d) - F.col(b))
    ends = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), CELL_BOX)]
    whole = cells.agg(*ends, F.avg(size_of(*CELL_BOX)).alias("mean")).first()
    extent = [whole[c] for c in CELL_BOX]
    if extent[0] is None:
        return broadcast_pairs(features, cells)
    tile = float(tile or whole["mean"] or 1.0)
    span = max(extent[2] - extent[0], extent[3] - extent[1])
    top = max(0, math.ceil(math.log2(max(span / tile, 1.0)))) + 1

    def level(names):
        size = size_of(*names)
        return F.when(size <= tile, F.lit(0)).otherwise(F.least(F.ceil(F.log2(size / tile)), F.lit(top))).cast("int")

    used = sorted(r[0] for r in cells.select(level(CELL_BOX)).distinct().collect())
    taken = [*features.columns, *cells.columns]
    fl, cl, at, tx, ty, *inner = fresh(taken, "feature_level", "cell_level", "level", "tx", "ty", "inner_minx", "inner_miny", "inner_maxx", "inner_maxy")
    size = F.lit(tile) * F.pow(F.lit(2.0), F.col(at))

    def tiles(df, names):
        steps = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
        return df.withColumn(tx, F.explode(steps(names[0], names[2]))).withColumn(ty, F.explode(steps(names[1], names[3])))

    near = features.where(finite(*BOX) & overlaps(*BOX, extent))
    cut_to = [F.greatest(F.col(b), F.lit(float(e))) if k < 2 else F.least(F.col(b), F.lit(float(e))) for k, (b, e) in enumerate(zip(BOX, extent))]
    near = near.withColumns(dict(zip(inner, cut_to))).withColumn(fl, level(inner))
    own = F.array_union(F.array(F.col(fl)), F.filter(F.array(*map(F.lit, used)), lambda x: x > F.col(fl)))
    left = tiles(near.withColumn(at, F.explode(own)), inner)
    right = tiles(cells.withColumn(cl, level(CELL_BOX)).withColumn(at, F.explode(F.sequence(F.col(cl), F.lit(top)))), CELL_BOX)
    joined = left.join(right, [at, tx, ty]).where(F.col(at) == F.greatest(fl, cl))
    corner = (F.floor(F.greatest(inner[0], "cminx") / size) == F.col(tx)) & (F.floor(F.greatest(inner[1], "cminy") / size) == F.col(ty))
    return joined.where(overlaps(*BOX, [F.col(c) for c in CELL_BOX]) & corner).drop(fl, cl, at, tx, ty, *inner)


def pairs(features: DataFrame, cells: DataFrame, tile: float | None = None) -> DataFrame:
    """Overlapping pairs by whichever plan fits the number of cells."""
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        return broadcast_pairs(features, cells)
    return tiled_pairs(features, cells, tile)


def cell_counts(features: DataFrame, cells: DataFrame, tile: float | None = None, plan: str = "auto") -> DataFrame:
    """cells with n, the features that meet each, and n_tagged, those of them that are tagged."""
    found = {"auto": lambda: pairs(features, cells, tile), "broadcast": lambda: broadcast_pairs(features, cells), "tiled": lambda: tiled_pairs(features, cells, tile)}[plan]()
    return _all_cells(cells, _counts(found))

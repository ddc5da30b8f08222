"""Connected components of a table of links, by joins and group-bys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_groups

#: Up to so many links (some ten MB) one task may get all of a node; beyond, they are dealt out.
FEW = 500_000


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long): root is the smallest node reachable.

    Large-star and small-star steps take turns until nothing changes (Kiveris et al. 2014):
    each hangs a node's neighbours on the smallest of them, so that links stay as many or
    get fewer. The rounds grow with the logarithm of the links at most squared; there is no
    limit to them. A node with very many links is dealt out over many tasks. Links of a
    node with itself and nulls say nothing; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    state, before = _state(edges), None
    while state != before:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # what hangs on a larger node keeps its own link, now to that node's smallest neighbour
        small = _with_least(large.where("u <> v").distinct(), state[0])
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.distinct())
        before, state = state, _state(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """u, v and m, the smallest v of each u, for n links or some times that."""
    if n <= FEW:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        return edges.join(least, F.col("u") == F.col("c")).drop("c")
    return with_groups(edges, ["u"], ["v"], {"m": (F.min("v"), F.min)})


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

"""Rows that share a key, brought together in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows that a bin of keys holds on average; a key with more than GROUP is compared chunk by chunk.
BIN, GROUP, CHUNK = 2_048, 4_096, 2_048
#: Up to so many keys with more than GROUP rows (some MB) are broadcast; more are joined by a shuffle.
BROADCAST = 50_000


def meet(rows: DataFrame, key: str, node: str, n_rows: int, compare, schema: str) -> DataFrame:
    """What compare gives for the rows of each key: compare(table) of some whole keys, or compare(first, second) of two chunks of one.

    Keys are dealt into bins whose number follows n_rows. A key with more than GROUP rows is
    dealt out, by a hash of node, as pairs of chunks instead, so that no task holds more than
    two chunks of it; of a chunk paired with itself first and second are the same table.
    rows is read twice, so it should be a stored table or cheap to derive from one.
    """
    bins = max(1, -(-n_rows // BIN))
    hot = rows.groupBy(key).count().where(F.col("count") > GROUP)
    hot = cut(hot.select(key, F.ceil(F.col("count") / CHUNK).cast("int").alias("parts")))
    if not (n_hot := hot.count()):
        dealt = rows.withColumn("parts", F.lit(0))
    else:
        dealt = rows.join(F.broadcast(hot) if n_hot <= BROADCAST else hot, key, "left").na.fill(0, ["parts"])
    some = F.greatest("parts", F.lit(1))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(node), some).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), some - 1)))
    alone = F.col("parts") == 0
    dealt = dealt.select(
        *rows.columns,
        "chunk",
        F.when(alone, F.pmod(F.xxhash64(key), F.lit(bins))).otherwise(F.xxhash64(key)).alias("bin"),
        F.when(alone, F.lit(-1)).otherwise(F.least("chunk", "other")).alias("lo"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("chunk", "other")).alias("hi"),
    )

    def run(group, table):
        import pyarrow.compute as pc

        lo, hi = group[1].as_py(), group[2].as_py()
        if lo == hi:
            return compare(table, table)
        return compare(*(table.filter(pc.equal(table.column("chunk"), c)) for c in (lo, hi)))

    return dealt.groupBy("bin", "lo", "hi").applyInArrow(run, schema)

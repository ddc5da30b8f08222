"""Exact top-k search by inner product: branch and bound over dimension blocks.

Candidates lie in blocks, stored dimension by dimension. A query's scores grow block of
dimensions by block; what the rest can still add is bounded by the product of the norms
of the remaining parts, and candidates that can't reach the k-th best are compacted away.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import stored

#: Queries and candidates that meet in one task, and candidates in a block there.
QUERIES, CANDIDATES, BLOCK = 4_096, 16_384, 8_192
#: Dimensions in a block.
STEP = 8
#: Scores below this fit a long with room for what is added to them; larger ones are summed as Python's integers.
SAFE = 2.0**61

SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "row", "vec_id", "score")])


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, vec_id and x, the vector as doubles, kept as a table; row tells rows with equal or null ids apart.

    Null vectors, and those with null or non-finite components, take no part; empty ones do.
    """
    x = F.transform(vector, lambda x: x.cast("double"))
    fit = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & fit)
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")


def whole(x):
    """floor(256 * x) for an array of finite doubles: as longs if products and their sums can't leave them, else as Python's integers."""
    import numpy as np

    if not x.size or float(np.abs(x).max()) < 2.0**44:
        return np.floor(256 * x).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * 256 if abs(v) >= 2.0**53 else math.floor(256 * v) for v in x.ravel().tolist()]
    return out


def floats(values):
    """The nearest doubles, infinity beyond their range."""
    import numpy as np

    if values.dtype != object:
        return values.astype(np.float64)
    return np.array([float(v) if abs(v) < 1 << 1023 else math.inf for v in values.ravel().tolist()]).reshape(values.shape)


class Block:
    """Candidates of one dimension count in vertical layout, the most spread dimensions first."""

    def __init__(self, values):
        import numpy as np

        self.size = len(values)
        near = floats(values)
        self.order = np.argsort(-np.abs(near).sum(axis=0), kind="stable") if self.size else np.arange(values.shape[1])
        self.columns = np.ascontiguousarray(values[:, self.order].T)
        with np.errstate(over="ignore"):
            squares = near[:, self.order].T ** 2
        starts = range(0, len(self.columns), STEP)
        rest = np.zeros((len(starts) + 1, self.size))
        for b in reversed(range(len(starts))):
            rest[b] = rest[b + 1] + squares[starts[b] : starts[b] + STEP].sum(axis=0)
        self.rest = np.sqrt(rest)
        self.most = float(self.rest[0].max(initial=0.0))

    def search(self, query, k: int, least):
        """Places and scores of the candidates that may be among the k best; least: a score that k others reach, or None."""
        import numpy as np

        q = query[self.order]
        with np.errstate(over="ignore"):
            squares = floats(q) ** 2
        total = math.sqrt(float(squares.sum()))
        columns = self.columns
        if not total * self.most < SAFE:
            # no bound holds beyond 53 bits, so all are scored exactly
            found = [sum(int(a) * int(b) for a, b in zip(q, c)) for c in columns.T]
            return np.arange(self.size), np.array(found, object) if found else np.zeros(0, object)
        if columns.dtype == object or q.dtype == object:
            columns, q = columns.astype(np.int64), q.astype(np.int64)
        rows, scores = None, np.zeros(self.size, np.int64)
        slack = 1e-9 * total * self.most + 1
        for b, start in enumerate(range(0, len(q), STEP)):
            part = columns[start : start + STEP]
            part = part if rows is None else part[:, rows]
            scores = scores + q[start : start + STEP] @ part
            rest = self.rest[b + 1] if rows is None else self.rest[b + 1][rows]
            reach = np.sqrt(squares[start + STEP :].sum()) * rest * (1 + 1e-9) + slack
            floor = least
            if len(scores) > k:
                low = scores - reach
                kth = np.partition(low, len(low) - k)[len(low) - k]
                floor = kth if floor is None else max(floor, kth)
            if floor is not None:
                keep = np.flatnonzero(scores + reach >= floor)
                if len(keep) * 4 < len(scores) * 3:
                    rows = keep if rows is None else rows[keep]
                    scores = scores[keep]
        return (np.arange(self.size) if rows is None else rows), scores


def _matrix(table):
    """(dimensions, rows of the table, whole numbers) for each dimension count in it."""
    import numpy as np

    column = table.column("x").combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, whole(flat[offsets[:-1][at][:, None] + np.arange(size)].reshape(len(at), size))


def best_of(queries, candidates, k: int):
    """SCHEMA rows: for each query of one table the k best of the candidates in the other, ties to the smaller id."""
    import numpy as np
    import pyarrow as pa

    by_size = {size: (at, values) for size, at, values in _matrix(queries)}
    ask = [queries.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id")]
    rows, ids = candidates.column("row").to_numpy(), candidates.column("vec_id").to_pylist()
    last = (1 << 63, 1 << 63)
    order = lambda x: (-x[0], *((ids[x[1]], rows[x[1]]) if ids[x[1]] is not None else last), rows[x[1]])
    found = {}
    for size, at, values in _matrix(candidates):
        if size not in by_size:
            continue
        asked, vectors = by_size[size]
        for s in range(0, len(at), BLOCK):
            some, block = at[s : s + BLOCK], Block(values[s : s + BLOCK])
            for n, query in zip(asked.tolist(), vectors):
                best = found.setdefault(n, [])
                # its own row may be among the best, so one more is looked for
                places, scores = block.search(query, k + 1, best[k - 1][0] if len(best) >= k else None)
                if len(places) > k + 1:
                    kth = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    chosen = np.flatnonzero(scores >= kth)
                    places, scores = places[chosen], scores[chosen]
                mine = ask[0][n]
                new = [(x, p) for x, p in zip(scores.tolist(), some[places].tolist()) if rows[p] != mine]
                found[n] = sorted(best + new, key=order)[:k]
    out = [(ask[0][n], ask[1][n], rows[p], ids[p], x) for n, best in found.items() for x, p in best]
    if any(not -(1 << 63) <= r[4] < 1 << 63 for r in out):
        raise OverflowError("a score does not fit a long")
    return pa.table({f.name: pa.array([r[j] for r in out], pa.int64()) for j, f in enumerate(SCHEMA.fields)})


def search(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller vec_id, null ids last.

    Both frames are as usable() gives them, queries a part of candidates. A query is scored
    against all rows with as many dimensions but its own row; fewer than k of them give fewer
    rows. Rows with one id are queries and candidates of their own. Queries and candidates
    are dealt into blocks by a hash of their row, and each pair of blocks is one task's; what
    is sent around grows with the product of the two numbers over a block's size, as the
    work does, and the plan does not. A best score that does not fit a long is an error.
    """
    n_queries, n_rows = queries.count(), candidates.count()
    across, down = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // CANDIDATES))
    tasks = across * down
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = queries.withColumn("q", block(across, 1)).withColumn("c", others(down))
    b = candidates.withColumn("c", block(down, 2)).withColumn("q", others(across))
    dealt = [x.select((F.col("c") * across + F.col("q")).alias("task"), "row", "vec_id", "x").repartition(tasks, "task").groupBy("task") for x in (a, b)]
    rows = dealt[0].cogroup(dealt[1]).applyInArrow(lambda x, y: best_of(x, y, k), SCHEMA)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all rows for every row whose vec_id is divisible by 50."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
"""

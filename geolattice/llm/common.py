"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, fresh, shared_dir, stored

__all__ = ["BLANKS", "byte_slices", "cut", "fresh", "joined", "let", "runs", "shared_dir", "stored", "tidy", "with_groups", "worker_state"]

#: Words are maximal runs of characters other than these (a Java regex class body).
BLANKS = r"\x20\x09-\x0D"


#: Parts that the rows of one key are dealt into before they meet as a group.
PARTS = 1_024


def with_groups(rows: DataFrame, keys: list[str], by: list[str], aggregates: dict, where=None) -> DataFrame:
    """rows with aggregates over all rows of their key; a key's rows never meet in one task.

    aggregates: name to (column over rows, function that merges such columns). Rows of one
    key are dealt into PARTS by the columns in by; each part is aggregated, these few rows are
    aggregated by key, and the result goes back to the parts. where, on the merged columns,
    says which keys' rows stay. Rows with a null key go. rows should be a stored table.
    """
    (salt,) = fresh([*rows.columns, *aggregates], "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(PARTS)))
    some = dealt.groupBy(*keys, salt).agg(*(c.alias(n) for n, (c, _) in aggregates.items()))
    whole = some.groupBy(*keys).agg(*(merge(n).alias(n) for n, (_, merge) in aggregates.items()))
    whole = whole if where is None else whole.where(where)
    return dealt.join(some.select(*keys, salt).join(whole, keys), [*keys, salt]).drop(salt)


def joined(rows: DataFrame, other: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows with the columns of other, which has a key once at most; a key's rows never meet in one task.

    Rows of one key are dealt into PARTS by the columns in by, and each part gets other's row.
    """
    (salt,) = fresh([*rows.columns, *other.columns], "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(PARTS)))
    some = dealt.select(*keys, salt).distinct()
    return dealt.join(some.join(other, keys), [*keys, salt]).drop(salt)


def worker_state(key, make):
    """A value made once for each Python worker process and kept between its tasks."""
    home = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks"))
    if key not in home.__dict__.setdefault("values", {}):
        home.values[key] = make()
    return home.values[key]


def tidy() -> None:
    """Gives memory that this worker process no longer uses back to the machine, so that idle workers stay small."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let(value, use):
    """use(value), with value evaluated once for each row however often use() names it."""
    return F.transform(F.array(value), use)[0]


def byte_slices(column, most: int):
    """(start, stop) runs of rows of an Arrow string column, each of about most bytes or one row."""
    import pyarrow.compute as pc

    return runs(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def runs(sizes: list[int], most: int):
    """(start, stop) runs of items, each of about most in size or one item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)

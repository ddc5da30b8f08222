"""Near copies by SimHash and a Gray-order index.

Fingerprints within a few bits of each other agree in at least one (or two, or three) of a
few more blocks of bits, so they meet under a block's value. There they are sorted by Gray
rank, which puts close bit patterns side by side, and cut into leaves. A leaf keeps
the bits that all its fingerprints share as a mask and a value; a node above does
so for its leaves. Two nodes are compared by the bits both masks hold; the
differences found there add up on the way down, and pairs of groups over the limit
are dropped as a whole. Only links that join something new are handed on, so a
group of n fingerprints gives fewer than n rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, joined
from .graph import components
from .meet import meet

LEAF, FANOUT = 64, 16
#: Fingerprints under one value, on average over all values that its bits can have, beyond which one more block must agree.
CROWD = 1_024


def fingerprint(hashes):
    """The 64-bit number whose bits are those set in over half of the hashes, an array of unsigned 64-bit numbers; 0 for none."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * total > len(hashes)].sum(dtype=np.uint64))


def shingle_hashes(text: str | None, words: int):
    """The hash of each shingle of a text, repeats included.

    A-Z are lowered; words are split at the six ASCII blanks. A text with fewer words is one
    shingle; one without words or a null has none.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint, as a long, of each text; 0 for one without words and for a null."""
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = np.array([fingerprint(shingle_hashes(x.as_py(), words)) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], out.names)

    return docs.select(doc_id, text).mapInArrow(run, out)


def gray_rank(x):
    """The place of each number in the order of Gray codes, for an array of unsigned 64-bit numbers."""
    import numpy as np

    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Leaves and nodes above them over fingerprints in Gray order."""

    def __init__(self, fingerprints):
        import numpy as np

        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.values = fingerprints[self.order]
        self.leaf = self._level(self.values, LEAF)
        self.node = self._join(*self.leaf, FANOUT)

    @staticmethod
    def _level(values, size):
        import numpy as np

        at = np.arange(0, len(values), size)
        ones, some = np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at)
        return ~(ones ^ some), ones

    @staticmethod
    def _join(mask, value, size):
        import numpy as np

        at = np.arange(0, len(mask), size)
        ones = np.bitwise_and.reduceat(value & mask, at)
        some = np.bitwise_or.reduceat(value | ~mask, at)
        return ~(ones ^ some) & np.bitwise_and.reduceat(mask, at), ones

    def pairs(self, other: GrayIndex, limit: int):
        """Blocks of places (i, j) in the two orders that differ in at most limit bits, leaf pair by leaf pair."""
        import numpy as np

        (nm, nv), (om, ov) = self.node, other.node
        shared = nm[:, None] & om
        high = np.bitwise_count((nv[:, None] ^ ov) & shared)
        (lm, lv), (km, kv) = self.leaf, other.leaf
        for a, b in zip(*np.nonzero(high <= limit)):
            if self is other and b < a:
                continue
            la, lb = slice(a * FANOUT, (a + 1) * FANOUT), slice(b * FANOUT, (b + 1) * FANOUT)
            seen = shared[a, b]
            more = np.bitwise_count((lv[la, None] ^ kv[lb]) & lm[la, None] & km[lb] & ~seen)
            for x, y in zip(*np.nonzero(high[a, b] + more.astype(np.int64) <= limit)):
                x, y = a * FANOUT + x, b * FANOUT + y
                if self is other and y < x:
                    continue
                p, q = x * LEAF, y * LEAF
                near = np.bitwise_count(self.values[p : p + LEAF, None] ^ other.values[None, q : q + LEAF]) <= limit
                yield p, q, near


def forest(first: GrayIndex, second: GrayIndex, limit: int):
    """Links within limit bits that connect all that such links connect, without cycles: places in the two orders."""
    import numpy as np

    same = first is second
    n = len(first.values)
    label = np.arange(n if same else n + len(second.values))
    other = label[:n] if same else label[n:]
    for p, q, near in first.pairs(second, limit):
        while True:
            new = near & (label[p : p + LEAF][: n - p, None] != other[None, q : q + LEAF])
            if not new.any():
                break
            i, j = divmod(int(new.argmax()), new.shape[1])
            a, b = label[p + i], other[q + j]
            label[label == max(a, b)] = min(a, b)
            yield p + i, q + j


def blocks_to_agree(n: int, limit: int) -> int:
    """How many of limit + agree blocks near fingerprints must share, for n of them: the fewest whose bits have n / CROWD values or more."""
    agree = 1
    while agree < 64 - limit and n > CROWD << 64 * agree // (limit + agree):
        agree += 1
    return agree


def links(nodes: DataFrame, limit: int = 4, agree: int | None = None) -> DataFrame:
    """a, b: links that connect what pairs of nodes (node long, fp long) within limit bits connect.

    Fingerprints are cut into limit + agree blocks, of which near ones share agree. By
    default agree follows the number of nodes, so that the number under one value stays
    the same as they grow, and with it the work for each; each has
    (limit + agree choose agree) values. Fingerprints must be distinct. Whatever is near
    within a bin of values is a link, under one value or not. Only where the nodes
    themselves lie close together, as very many near copies of one text, do many share a
    value; these are compared chunk by chunk, no chunk pair in a task with another.
    """
    n = nodes.count()
    agree = agree or blocks_to_agree(n, limit)
    blocks = limit + agree
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in ks) for ks in combinations(range(blocks), agree)]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)))) for k, mask in enumerate(masks)]
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("value"))

    def compare(first, second):
        import numpy as np
        import pyarrow as pa

        sides = [first] if first is second else [first, second]
        found, named = [], []
        for table in sides:
            fp = table.column("fp").to_numpy().view(np.uint64)
            once = np.unique(fp, return_index=True)[1]
            index = GrayIndex(fp[once])
            named.append((index, table.column("node").to_numpy()[once][index.order]))
        if all(len(index.values) for index, _ in named):
            (one, a), (two, b) = named[0], named[-1]
            found = [(a[i], b[j]) for i, j in forest(one, two, limit)]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return meet(rows, "value", "node", n * len(keys), compare, "a long, b long")


def near_copies(docs: DataFrame, words: int = 4, limit: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component for every row: component is the smallest id linked to it, directly or by others.

    Rows with equal fingerprints are one class, with its smallest id as node. A row without
    an id belongs to its class's component but is never its name; a class of such rows
    has none and links nothing. Rows that share an id may have components of their own.
    """
    rows = cut(fingerprints(docs, words, doc_id, text))
    # ids may name several classes, so classes are told apart by a number of their own
    classes = rows.groupBy("fp").agg(F.min(doc_id).cast("long").alias("least"))
    classes = cut(classes.select("fp", "least", F.monotonically_increasing_id().alias("node")))
    roots = components(links(classes.where("least IS NOT NULL").select("node", "fp")))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return joined(rows, named.join(least, "root").select("fp", "component"), ["fp"], [doc_id]).select(doc_id, "fp", "component")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_copies(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

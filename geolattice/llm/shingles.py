"""Near copies by the exact similarity of shingle sets, for a similarity beyond the reach of few bits.

Fingerprints of two texts at a similarity of 0.8 differ in ten of 64 bits in the mean, so no
limit that an index of them can serve finds all such texts. Here the SimHash index
proposes what lies within its limit, and least hashes of the sets, joined to one key
a band, propose what it can't reach: two sets at a similarity s share no key with a chance of
(1 - s ** ROWS) ** BANDS, 3e-5 at 0.8. Every proposed pair is decided by the sets
themselves. First come the index's pairs and those with one or two centres of each key, which
join large groups by few pairs; then whatever is still apart under a key and looks alike by
its least hashes is compared there, chunk by chunk, and only links are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, fresh, joined, stored, tidy, with_groups
from .graph import components
from .meet import meet

BANDS, ROWS = 20, 4
#: Shingles hashed under all functions at a time, and texts handed on together.
SHINGLES, TEXTS = 2_048, 256
#: How far below the wanted similarity the share of equal least hashes (a byte of each) may lie; five deviations at 0.8.
SLACK = 0.22


def row_key(doc_id: str, text: str):
    """Tells rows that share an id apart; equal rows are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def signatures(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, key, digest of the shingle set, fp, marks and keys of each text.

    fp is the text's fingerprint, marks a byte of each least hash, keys one long a band. A
    text without words and a null have an empty set.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest, xxh64_intdigest

        rng = np.random.default_rng(17)
        mix = rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
        times = rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)

        def one(text):
            hashes = simhash.shingle_hashes(text, words)
            h = np.unique(hashes)
            least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
            for k in range(0, len(h), SHINGLES):
                least = np.minimum(least, ((h[k : k + SHINGLES] ^ mix) * times).min(axis=1))
            keys = np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)
            marks = (least >> np.uint64(20)).astype(np.uint8)
            return xxh3_128_digest(h.tobytes()), simhash.fingerprint(hashes), marks.tobytes(), keys

        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                digests, fps, marks, keys = zip(*(one(x.as_py()) for x in part.column(2)))
                fps = pa.array(np.array(fps, np.uint64).view(np.int64))
                columns = [*part.columns[:2], pa.array(digests, pa.binary()), fps, pa.array(marks, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "digest", "fp", "marks", "keys"])
        tidy()

    rows = docs.select(doc_id, row_key(doc_id, text).alias("key"), text)
    return rows.mapInArrow(run, f"doc {kind}, key long, digest binary, fp long, marks binary, keys array<long>")


def alike(x, y, least: float) -> bool:
    """Whether two sorted sets of hashes have a similarity of least or more; empty ones are alike."""
    import numpy as np

    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def texts_of(nodes: DataFrame, texts: DataFrame, places: DataFrame) -> DataFrame:
    """node, text of the given nodes, kept as a table. texts: doc, key, text; places: node, doc, key."""
    asked = nodes.distinct().join(places, "node").select("node", F.col("doc").alias("d"), F.col("key").alias("k"))
    found = texts.join(asked, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")))
    return stored(found.select("node", "text").dropDuplicates(["node"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs a, b of nodes whose shingle sets have a similarity of least or more.

    texts: doc, key, text; places: node, doc, key. Only the texts that pairs name are moved.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def shingles(node, text):
            if node not in held:
                if len(held) > 64:
                    held.clear()
                held[node] = np.unique(simhash.shingle_hashes(text.as_py(), words))
            return held[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [alike(shingles(i, x), shingles(j, y), least) for i, j, x, y in zip(a, b, batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        tidy()

    pairs = stored(pairs, "pairs")
    found = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts, places)
    sides = [found.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y"))]
    return cut(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _sides(first, second, names):
    """Columns of two tables as arrays, the second in order of key, and for each row of the first where its key's rows begin and end in the second."""
    import numpy as np

    one, two = ({n: t.column(n).to_numpy() for n in names} for t in (first, second))
    order = np.argsort(two["key"], kind="stable")
    two = {n: x[order] for n, x in two.items()}
    edges = np.searchsorted(two["key"], one["key"], "left"), np.searchsorted(two["key"], one["key"], "right")
    marks = [np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for t in (first, second)]
    return one, two, order, edges, marks[0], marks[1][order]


def with_lookalikes(members: DataFrame, n_rows: int, least: float) -> DataFrame:
    """key, node: rows (key, node, label, marks) that share their key with one of another label whose marks equal theirs for least of them or more."""

    def compare(first, second):
        import numpy as np
        import pyarrow as pa

        one, two, _, (lo, hi), mine, others = _sides(first, second, ["key", "node", "label"])
        found, met = [], np.zeros(len(others), bool)
        for i in range(len(mine)):
            some = np.flatnonzero(two["label"][lo[i] : hi[i]] != one["label"][i]) + lo[i]
            near = some[np.count_nonzero(others[some] == mine[i], axis=1) >= least * BANDS * ROWS]
            if len(near):
                found.append((int(one["key"][i]), int(one["node"][i])))
                # of two different chunks only this call sees the pair
                met[near] = True
        if first is not second:
            found += zip(two["key"][met].tolist(), two["node"][met].tolist())
        found = sorted(set(found))
        return pa.table({"key": pa.array([f[0] for f in found], pa.int64()), "node": pa.array([f[1] for f in found], pa.int64())})

    return meet(members, "key", "node", n_rows, compare, "key long, node long").distinct()


def linked(members: DataFrame, n_rows: int, words: int, least: float) -> DataFrame:
    """a, b: links between rows (key, band, node, label, marks, keys, text) that share their key, at a similarity of least or more.

    Pairs are compared where they meet, under the first key that they share, and only links that join something
    new there are handed on, so a key with n rows gives fewer than n for each pair of chunks.
    """

    def compare(first, second):
        import numpy as np
        import pyarrow as pa

        one, two, order, (lo, hi), mine, others = _sides(first, second, ["key", "band", "node", "label"])
        keys = [np.array(t.column("keys").to_pylist(), np.int64).reshape(-1, BANDS) for t in (first, second)]
        keys[1] = keys[1][order]
        texts = [t.column("text") for t in (first, second)]
        sets: dict = {}
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def shingles(side, i, node):
            if node not in sets:
                sets[node] = np.unique(simhash.shingle_hashes(texts[side][i].as_py(), words))
            return sets[node]

        found = []
        for i in range(len(mine)):
            node, label = int(one["node"][i]), int(one["label"][i])
            some = slice(lo[i], hi[i])
            apart = two["label"][some] != label
            if first is second:
                apart &= two["node"][some] > node
            some = np.flatnonzero(apart) + lo[i]
            some = some[np.count_nonzero(others[some] == mine[i], axis=1) >= (least - SLACK) * BANDS * ROWS]
            some = some[~(keys[1][some, : one["band"][i]] == keys[0][i, : one["band"][i]]).any(axis=1)]
            for j in some.tolist():
                if find(label) == find(int(two["label"][j])):
                    continue
                x, y = shingles(0, i, node), shingles(1, int(order[j]), int(two["node"][j]))
                if alike(x, y, least):
                    root[find(label)] = find(int(two["label"][j]))
                    found.append((node, int(two["node"][j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return meet(members, "key", "node", n_rows, compare, "a long, b long")


def groups(docs: DataFrame, words: int = 5, least: float = 0.8, limit: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, key, first_doc, first_key for every row: the first document, by id and then key, of those linked to it at a similarity of least or more, directly or by others.

    Documents without an id come last. Texts without words are alike.
    """
    rows = stored(signatures(docs, words, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "row")
    classes = cut(rows.groupBy("digest").agg(F.min(place).alias("place")))
    places = classes.select(F.col("place.row").alias("node"), "place.doc", "place.key")
    texts = docs.select(F.col(doc_id).alias("doc"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    nodes = rows.join(places.select("node"), F.col("row") == F.col("node"))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    near = simhash.links(prints, limit)
    same = nodes.select("node", "fp").join(prints.withColumnRenamed("node", "centre"), "fp")

    by_hash = F.struct(F.xxhash64("node"), "node")
    centres = {"one": (F.min("node"), F.min), "two": (F.min(by_hash), F.min), "n": (F.count("*"), F.sum)}
    members = stored(nodes.select("node", F.posexplode("keys").alias("band", "key")), "members")
    members = stored(with_groups(members, ["key"], ["node"], centres, "n > 1").select("key", "band", "node", "one", F.col("two.node").alias("two")), "keyed")
    stars = members.select("node", F.explode(F.array("one", "two")).alias("centre")).union(same.select("node", "centre"))
    stars = stars.where("node <> centre").select(*pair("node", "centre")).union(near.select(*pair("a", "b"))).distinct()
    links = verified(stars, texts, places, words, least)

    labelled = members.select("key", "band", "node").join(components(links), "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("label"))
    ends = {"lo": (F.min("label"), F.min), "hi": (F.max("label"), F.max)}
    apart = with_groups(stored(labelled, "labelled"), ["key"], ["node"], ends, "lo < hi").select("key", "band", "node", "label")
    apart = stored(apart.join(nodes.select("node", "marks", "keys"), "node"), "apart")
    near = stored(with_lookalikes(apart.select("key", "node", "label", "marks"), apart.count(), least - SLACK), "lookalikes")
    moved = apart.join(near, ["key", "node"]).join(texts_of(near.select("node"), texts, places), "node")
    rest = linked(stored(moved, "moved"), near.count(), words, least)
    roots = components(links.union(rest))

    found = classes.join(roots, F.col("place.row") == F.col("node"), "left").select("digest", "place", F.coalesce("root", F.col("place.row")).alias("root"))
    found = found.join(found.groupBy("root").agg(F.min("place").alias("first")), "root")
    found = found.select("digest", F.col("first.doc").alias("first_doc"), F.col("first.key").alias("first_key"))
    return joined(rows.select("doc", "key", "digest"), found, ["digest"], ["doc", "key"]).drop("digest")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, limit: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document, by id, of each group that groups() finds; rows equal in id and text are one document.

    Rows that share an id but not their text are documents of their own. All columns stay.
    """
    gone = groups(docs, words, least, limit, doc_id, text).where("NOT (doc <=> first_doc AND key = first_key)")
    doc, key, at = fresh(docs.columns, "doc", "key", "at")
    gone = gone.select(F.col("doc").alias(doc), F.col("key").alias(key)).distinct()
    base = docs.withColumn(at, row_key(doc_id, text))
    return base.join(gone, (F.col(at) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(doc)), "left_anti").drop(at)

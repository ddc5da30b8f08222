"""Quality and toxicity by co-training of two views.

One classifier sees a text's words and their beginnings, as far as they tell the classes
apart, and its shape; the other its metadata (source, language, length).
Both start from labelled rows; in each round each names those of all unlabelled documents it
is surest of, and these join the other's training rows. Each view is then calibrated on
rows held out, the two are combined there, and all documents are scored. Texts are
read once for their labels' sake and once for the features that count, which are kept as a table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Places of words and their beginnings, of a text's shape, and of metadata; columns that a text classifier is fitted to.
PLACES, SHAPE, META, COLUMNS = 1 << 18, 8, 256, 4_096
#: Bound of the labelled rows that reach the driver, by order of a hash of their ids.
LABELLED = 4_000
ROUNDS = 4
#: Rows of each class that a view may name in a round, of all unlabelled documents, and how sure it must be.
NAMED, SURE = 75, 0.9
#: Parts in which the surest rows are looked for before they are compared as a whole.
PARTS = 64


class Features:
    """Word and metadata features of rows; places are hashes, so all processes agree."""

    def __init__(self):
        class Places(dict):
            def __missing__(self, word):
                bare = word.strip(".,;:!?\"'()") or word
                if len(self) >= 200_000:
                    self.clear()
                # marked beginnings let words that were never labelled count by what they are made of
                keys = [bare, *("^" + bare[:k] for k in (3, 4, 5) if len(bare) > k)]
                out = self[word] = [zlib.crc32(k.encode()) % PLACES for k in keys]
                return out

        self.places = Places()

    def text(self, text: str | None):
        """Places and values, of length 1, of log counts of words and beginnings; then what the text's shape adds."""
        import numpy as np

        words = text.lower().split() if text else []
        n = len(words)
        if not n:
            return np.array([PLACES + SHAPE - 1]), np.array([1.0])
        counts = Counter(words)
        found = [self.places[w] for w in counts]
        each = np.fromiter(map(len, found), np.int64, len(found))
        at, of = np.unique(np.fromiter(chain.from_iterable(found), np.int64, each.sum()), return_inverse=True)
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(found)), each)
        values = np.log1p(np.bincount(of, weights=times))
        values /= math.sqrt(float(values @ values))
        marks = sum(text.count(c) for c in "#*$%&|<>")
        shape = [min(1.0, marks / n), min(1.0, len(text) / n / 16), len(counts) / n, min(1.0, math.log1p(n) / 10)]
        return np.concatenate([at, PLACES + np.arange(4)]), np.concatenate([values, shape])

    def meta(self, source, lang, n_chars):
        """Places of the source, the language and the length's power of two."""
        size = "none" if n_chars is None else str(int(n_chars).bit_length())
        return [zlib.crc32(f"{k}={v}".encode()) % (META - 1) for k, v in (("source", source), ("lang", lang), ("size", size))] + [META - 1]


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x, y, start=None, penalty: float = 2e-5, steps: int = 250):
    """Weights of a logistic regression, the last the constant, by accelerated gradient steps; classes weigh alike."""
    import numpy as np

    ones = max(1.0, float(y.sum()))
    weight = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * max(1.0, len(y) - ones))).astype(np.float32) / len(y)
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    v, norm = w.copy(), float((x * x).sum(axis=1).max(initial=1.0)) + 1
    rate = 4 / norm / 2
    for k in range(steps):
        g = weight * (_sigmoid(x @ v[:-1] + v[-1]) - y)
        step = v.copy()
        step[:-1] -= rate * (x.T @ g + penalty * v[:-1])
        step[-1] -= rate * g.sum()
        v = step + k / (k + 3) * (step - w)
        w = step
    return w


def held_out(n: int):
    """Which of n labelled rows serve calibration alone: every fifth."""
    import numpy as np

    return np.arange(n) % 5 == 4


def telling(places: list, labels: list):
    """The COLUMNS places that tell the classes apart best by a chi-square test of presence, and those of shape, in order."""
    import numpy as np

    n, ones = len(labels), float(sum(labels))
    present = np.zeros((2, PLACES + SHAPE))
    for at, label in zip(places, labels):
        present[int(label), at] += 1
    total = present.sum(axis=0)
    apart = present[1] * (n - ones - present[0]) - present[0] * (ones - present[1])
    chi = n * apart**2 / np.maximum(1, ones * (n - ones) * total * (n - total))
    best = np.argsort(-chi[:PLACES], kind="stable")[: COLUMNS - SHAPE]
    return np.concatenate([np.sort(best), PLACES + np.arange(SHAPE)])


class Target:
    """The two views of one label: labelled rows, rows that each was given, and what is fitted to them."""

    def __init__(self, text, meta, y):
        import numpy as np

        self.views, self.y, self.held = (text, meta), y, held_out(len(y))
        self.constant = None if len(y) and y.min() != y.max() else (0.0 if not len(y) else (4.0 if y[0] else -4.0))
        self.given = [[], []]  # for each view (id, text row, meta row, label)
        self.weights = [np.zeros(x.shape[1] + 1, np.float32) for x in self.views]
        self.started = False

    def fit(self):
        """Both views anew from the weights they had; nothing where all labels are of one class."""
        import numpy as np

        if self.constant is not None:
            return
        for v, x in enumerate(self.views):
            more = [g[1 + v] for g in self.given[v]]
            labels = np.concatenate([self.y[~self.held], [g[3] for g in self.given[v]]]).astype(np.float32)
            rows = np.concatenate([x[~self.held], np.stack(more)]) if more else x[~self.held]
            self.weights[v] = fit(rows.astype(np.float32), labels, self.weights[v] if self.started else None)
        self.started = True

    def give(self, view: int, low: list, high: list):
        """Rows that a view is surest are of class 0 and 1, the surest first, go to the other view, in the proportion of the labelled rows."""
        share = float(self.y.mean())
        n = min(len(high), int(len(low) * share / (1 - share)) + 1)
        low = low[: int(n * (1 - share) / share) + 1]
        self.given[1 - view] += [(*r, 0.0) for r in low] + [(*r, 1.0) for r in high[:n]]

    def taken(self, view: int) -> set:
        """Ids that a view need not name again."""
        return {g[0] for g in self.given[1 - view]}

    def combined(self):
        """The weights of both views and of their combination (text, meta, constant), calibrated on the rows held out."""
        import numpy as np

        if self.constant is not None:
            return *self.weights, np.array([0.0, 0.0, self.constant])
        known = self.y[self.held]
        margins = np.stack([x[self.held] @ w[:-1] + w[-1] for x, w in zip(self.views, self.weights)], axis=1).astype(np.float64)
        calibrated, scales = np.empty_like(margins), []
        for v in range(2):
            a, b = platt(margins[:, v], known)
            scales.append((a, b))
            calibrated[:, v] = a * margins[:, v] + b
        prior = math.log((known.sum() + 1) / ((1 - known).sum() + 1))
        # calibrated log odds of two views add up, less the prior that both contain
        joint = calibrated.sum(axis=1) - prior
        a, b = platt(joint, known)
        return *self.weights, np.array([a * scales[0][0], a * scales[1][0], a * (scales[0][1] + scales[1][1] - prior) + b])


def platt(margin, y, steps: int = 50):
    """a, b for which sigmoid(a * margin + b) fits y, a not below 0, by Newton steps with a small penalty."""
    import numpy as np

    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * margin + b)
        g = np.array([((p - y) * margin).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        r = p * (1 - p)
        h = np.array([[(r * margin * margin).sum() + 0.01, (r * margin).sum()], [(r * margin).sum(), r.sum() + 0.01]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(0.0, float(a)), float(b)


def _rows(docs: DataFrame, columns=None) -> DataFrame:
    """doc_id, at, value, meta of every row: the features of its text, of all places or of some columns, and of its metadata."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = None if columns is None else docs.sparkSession.sparkContext.broadcast(columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        features, column = Features(), None
        if shared is not None:
            column = np.full(PLACES + SHAPE, -1)
            column[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                ids, texts, *rest = batch.slice(k, 500).columns
                at, value = [], []
                for x in texts:
                    places, values = features.text(x.as_py())
                    if column is not None:
                        places = column[places]
                        places, values = places[places >= 0], values[places >= 0]
                    at.append(places.astype("<u4").tobytes())
                    value.append(values.astype("<f4").tobytes())
                meta = [features.meta(*m) for m in zip(*(c.to_pylist() for c in rest))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.binary()), pa.array(value, pa.binary()), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "at", "value", "meta"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, f"doc_id {kind}, at binary, value binary, meta array<int>")


def dense(rows, width: int):
    """Text and metadata matrices of rows with at, value and meta."""
    import numpy as np

    text, meta = np.zeros((len(rows), width), np.float32), np.zeros((len(rows), META), np.float32)
    for i, r in enumerate(rows):
        text[i, np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["value"], "<f4")
        meta[i, r["meta"]] = 1
    return text, meta


def margins(batch, text_weights, meta_weights):
    """For each row of a batch with at, value and meta the margins of both views, for weights of all targets side by side."""
    import numpy as np

    def sums(which, values, ends):
        out = np.zeros((batch.num_rows, which.shape[1]))
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            out[some] = np.add.reduceat(values, ends[some], axis=0)
        return out + which[-1]

    at, value, meta = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "value", "meta"))
    sizes = [len(x) // 4 for x in at.to_pylist()]
    flat = np.frombuffer(b"".join(at.to_pylist()), "<u4")
    values = np.frombuffer(b"".join(value.to_pylist()), "<f4").astype(np.float64)
    lists = [sorted(set(x)) for x in meta.to_pylist()]
    of = np.array([p for x in lists for p in x], np.int64)
    by_text = sums(text_weights, text_weights[flat] * values[:, None], np.cumsum([0, *sizes]))
    return np.stack([by_text, sums(meta_weights, meta_weights[of], np.cumsum([0, *map(len, lists)]))], axis=1)


def _side_by_side(pairs):
    import numpy as np

    return [np.stack([p[v] for p in pairs], axis=1).astype(np.float64) for v in range(2)]


def surest(rows: DataFrame, weights: list, taken: list, most: int = NAMED) -> list:
    """For each target and view the rows it is surest of: [target][view] = (low, high), each (id, at, value, meta) rows in order.

    weights: both views' weights for each target; taken: [target][view], ids that do not count. Rows
    without an id do not count either. Of equally sure rows the smaller ids come first; of
    rows with one id the first by a hash of its features counts. Tasks hand on at most so many each, so few rows are compared as a whole.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((_side_by_side(weights), taken))
    bar = math.log(SURE / (1 - SURE))

    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        (by_text, by_meta), taken = shared.value
        best: dict = {}
        key = lambda r: r[:3]
        for batch in batches:
            found = margins(batch, by_text, by_meta)
            ids = batch.column(0).to_pylist()
            for t, v, side in product(range(found.shape[2]), range(2), range(2)):
                sure = (-1, 1)[side] * found[:, v, t]
                some = [(-float(sure[i]), ids[i], i) for i in np.flatnonzero(sure > bar).tolist() if ids[i] is not None and ids[i] not in taken[t][v]]
                some = [(x, d, *(batch.column(c)[i].as_py() for c in (1, 2, 3))) for x, d, i in heapq.nsmallest(most, some)]
                best[t, v, side] = heapq.nsmallest(most, best.get((t, v, side), []) + some, key=key)
        out = [(*k, *r) for k, held in best.items() for r in held]
        names = ["target", "view", "side", "sure", "doc_id", "at", "value", "meta"]
        types = [pa.int32()] * 3 + [pa.float64(), None, pa.binary(), pa.binary(), pa.list_(pa.int32())]
        columns = [pa.array([r[j] for r in out], types[j] or id_type) for j in range(8)]
        yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    found = rows.mapInArrow(run, f"target int, view int, side int, sure double, doc_id {kind}, at binary, value binary, meta array<int>")
    group = ["target", "view", "side"]
    first = [F.col("sure"), F.col("doc_id"), F.col("at")]
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for w in (W.partitionBy(*group, "part"), W.partitionBy(*group)):
        found = found.withColumn("place", F.row_number().over(w.orderBy(*first))).where(F.col("place") <= most)
    out = [[([], []), ([], [])] for _ in weights]
    seen = set()
    for r in sorted(found.collect(), key=lambda r: (r.sure, r.doc_id, r["at"])):
        if (r.target, r.view, r.doc_id) not in seen:
            seen.add((r.target, r.view, r.doc_id))
            out[r.target][r.view][r.side].append(r)
    return out


def train(docs: DataFrame, labels: DataFrame, targets=("quality", "toxic"), labelled: int = LABELLED, named: int = NAMED) -> tuple:
    """A model and the features of docs, as a table, by which score() judges them.

    The fit sees at most so many labelled rows, and named rows a round, class, view and target
    of all others. Rows of labels without an id or a label of 0 or 1 say nothing; of several
    labels for one id the least counts, of several documents the first by a hash of its columns.
    """
    import numpy as np

    rank = lambda c: F.xxhash64(F.lit("sample"), F.col(c))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.min(t).alias(t) for t in targets))
    for t in targets:
        known = known.where(F.col(t).isin(0, 1))
    wanted = {r.doc_id: [r[t] for t in targets] for r in known.orderBy(rank("doc_id"), "doc_id").limit(labelled).collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted], "wanted long")
    inputs = ["text", "source", "lang", "n_chars"]
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("wanted")).groupBy("doc_id").agg(F.min_by(F.struct(*inputs), F.xxhash64(*inputs)).alias("d"))
    found = {r.doc_id: r for r in _rows(rows.select("doc_id", "d.*")).collect()}
    keys = sorted(found)
    seen = [k for k, h in zip(keys, held_out(len(keys))) if not h]
    own = [telling([np.frombuffer(found[k]["at"], "<u4") for k in seen], [wanted[k][j] for k in seen]) for j in range(len(targets))]
    columns = np.unique(np.concatenate(own))
    table = stored(_rows(docs, columns), "features")

    full = np.full(PLACES + SHAPE, -1)
    full[columns] = np.arange(len(columns))
    mine = [full[c] for c in own]  # a target's columns among all

    def narrow(r):
        at = full[np.frombuffer(r["at"], "<u4")]
        return {"at": at[at >= 0].astype("<u4").tobytes(), "value": np.frombuffer(r["value"], "<f4")[at >= 0].tobytes(), "meta": r["meta"]}

    text, meta = dense([narrow(found[k]) for k in keys], len(columns))
    fits = [Target(text[:, mine[j]], meta, np.array([wanted[k][j] for k in keys], np.float64)) for j in range(len(targets))]

    def wide(j):
        w = np.zeros(len(columns) + 1, np.float32)
        w[mine[j]], w[-1] = fits[j].weights[0][:-1], fits[j].weights[0][-1]
        return w, fits[j].weights[1]

    for k in range(ROUNDS):
        for f in fits:
            f.fit()
        if k + 1 == ROUNDS or all(f.constant is not None for f in fits):
            break
        taken = [[f.taken(v) | set(keys) for v in range(2)] for f in fits]
        for j, views in enumerate(surest(table, [wide(j) for j in range(len(fits))], taken, named)):
            if fits[j].constant is None:
                for v, sides in enumerate(views):
                    made = []
                    for side in sides:
                        x, m = dense(side, len(columns))
                        made.append([(r.doc_id, a[mine[j]], b) for r, a, b in zip(side, x, m)])
                    fits[j].give(v, *made)
    model = {t: (*wide(j), fits[j].combined()[2]) for j, t in enumerate(targets)}
    return model, table


def score(table: DataFrame, model: dict) -> DataFrame:
    """doc_id and for each target the probability by text, by metadata and by both, for every row of the features that train() gives.

    A null or empty text is judged by the one feature of such texts, null metadata by that of nulls.
    """
    names = [f"{t}{part}" for t in model for part in ("_by_text", "_by_meta", "")]
    kind = table.schema["doc_id"].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast(list(model.values()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        by_text, by_meta = _side_by_side(shared.value)
        joint = np.stack([m[2] for m in shared.value], axis=1)
        for batch in batches:
            found = margins(batch, by_text, by_meta)
            both = _sigmoid(found[:, 0] * joint[0] + found[:, 1] * joint[1] + joint[2])
            single = _sigmoid(found)
            columns = [c for k in range(joint.shape[1]) for c in (single[:, 0, k], single[:, 1, k], both[:, k])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *names])

    schema = ", ".join([f"doc_id {kind}", *(f"{n} double" for n in names)])
    return table.mapInArrow(run, schema)


def op4_cotraining(spark, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document, and whether it is kept: likely good and not likely toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, table = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(table, model).withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))

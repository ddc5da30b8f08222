"""Stupid-backoff scores from tables of n-gram counts, by joins.

The score of a token after the n - 1 before it is count(all n) / count(the n - 1) if the n
are found least times or more, else 0.4 times its score after n - 2; a token alone scores
count / N. Each place of a text asks for one n-gram, the longest that ends there. Texts are
tokenized once, into a table of the n-grams of each chunk of texts with the texts that ask
for them; counts are summed by n-gram, turned into scores by joins with the counts of
shorter ones, joined back to the chunks, and summed by text. Logarithms are whole
numbers of 1 / UNIT, so that sums do not depend on their order.
"""

from __future__ import annotations

import math

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, worker_state
from .packing import WordTokens

UNIT = 1 << 20
BACKOFF = 0.4
#: Longest n-gram by default; with three, most n-grams of a text are its own, and tables take several times the space of the texts.
ORDER = 2
#: Bits of a token id in an n-gram, which is a long; so many fit three tokens.
BITS = 21
#: Texts, and tokens beyond which a chunk takes no further text.
TEXTS, TOKENS = 500, 4_000_000
#: Entries of a worker's table of recent words.
RECENT = 400_000


def postings(docs: DataFrame, tokenizer: str, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk, n, gram, count, rows, doc, kept as a table: for each chunk of texts its n-grams up to order.

    rows has a text's number in the chunk for each place that asks for the n-gram. A row with
    n = 0 stands for text number gram itself, with its tokens as count and its id as doc.
    Token ids beyond 2**21 - 1 are an error.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens = worker_state(("word", tokenizer, RECENT), lambda: WordTokens(tokenizer, RECENT))
        chunk, held, names, size = TaskContext.get().partitionId() << 32, [], [], 0

        def rows(n, gram, count, of, ends, doc):
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(of, pa.int32()))
            some = len(gram)
            columns = [pa.array(np.full(some, chunk)), pa.array(np.full(some, n, np.int32)), pa.array(gram, pa.int64()), pa.array(count, pa.int64()), lists, doc]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "n", "gram", "count", "rows", "doc"])

        def tables():
            ids = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            if len(ids) and ids.max() >> BITS:
                raise ValueError(f"token id {ids.max()} exceeds {BITS} bits")
            sizes = np.fromiter((len(x) // 4 for x in held), np.int64, len(held))
            nothing = np.zeros(0, np.int32)
            yield rows(0, np.arange(len(held)), sizes, nothing, np.zeros(len(held) + 1, np.int32), pa.concat_arrays(names))
            of = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gram = ids
            for n in range(1, order + 1):
                if n > 1:
                    gram = np.append(np.zeros(1, np.int64), gram[:-1])[: len(ids)] << BITS | ids
                here = np.flatnonzero(place >= n - 1)
                by_gram = here[np.argsort(gram[here], kind="stable")]
                g = gram[by_gram]
                asks = np.ones(len(g), bool) if n == order else place[by_gram] == n - 1
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else nothing
                ends = np.append(0, np.cumsum(asks))[np.append(first, len(g))]
                asked = of[by_gram[asks]]
                for k in range(0, len(first), 500_000):
                    to = min(k + 500_000, len(first))
                    edges = ends[k : to + 1]
                    yield rows(n, g[first[k:to]], np.diff(np.append(first, len(g))[k : to + 1]), asked[edges[0] : edges[-1]], edges - edges[0], pa.nulls(to - k, names[0].type))

        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                held += tokens.encode(part.column(1).to_pylist())
                names.append(part.column(0))
                size += sum(map(len, held[-part.num_rows :])) // 4
                if size > TOKENS:
                    yield from tables()
                    chunk, held, names, size = chunk + 1, [], [], 0
        if held:
            yield from tables()
        tidy()

    return stored(docs.select(doc_id, text).mapInArrow(run, f"chunk long, n int, gram long, count long, rows array<int>, doc {kind}"), "grams")


def counts(grams: DataFrame) -> DataFrame:
    """n, gram, count, asked, kept as a table: how often each n-gram occurs and whether a text asks for it, of the rows that postings() gives."""
    found = grams.where("n > 0").groupBy("n", "gram").agg(F.sum("count").alias("count"), F.max(F.size("rows")).alias("asked"))
    return stored(found.withColumn("asked", F.col("asked") > 0), "counts")


def _units(count) -> F.Column:
    return F.round(F.log(count.cast("double")) * UNIT).cast("long")


def gram_scores(asked: DataFrame, table: DataFrame, order: int = ORDER, least: int = 1) -> DataFrame:
    """n, gram, units: the score of each n-gram asked for (n, gram, distinct) by the counts in table, in units.

    An n-gram found less than least times is scored by its tokens but the first, at a
    penalty. A token that the table lacks scores as one found once.
    """
    total = table.where("n = 1").agg(F.sum("count")).first()[0] or 1
    parts, rest = [], asked.select("n", "gram", F.col("gram").alias("tail"), F.lit(0).cast("long").alias("units"))
    for m in range(order, 1, -1):
        known = table.where((F.col("n") == m) & (F.col("count") >= least)).select(F.col("gram").alias("tail"), F.col("count").alias("c"))
        context = table.where(F.col("n") == m - 1).select(F.col("gram").alias("before"), F.col("count").alias("of"))
        here = rest.where(F.col("n") >= m).join(known, "tail", "left").withColumn("before", F.shiftright("tail", BITS))
        met = here.where("c IS NOT NULL").join(F.broadcast(context) if m == 2 else context, "before")
        parts.append(met.select("n", "gram", (F.col("units") + _units(F.col("c")) - _units(F.col("of"))).alias("units")))
        shorter = F.col("tail").bitwiseAND(F.lit((1 << BITS * (m - 1)) - 1))
        missed = here.where("c IS NULL").select("n", "gram", shorter.alias("tail"), (F.col("units") + round(math.log(BACKOFF) * UNIT)).alias("units"))
        rest = rest.where(F.col("n") < m).union(missed)
    # no more rows than the vocabulary has tokens
    single = F.broadcast(table.where("n = 1").select(F.col("gram").alias("tail"), F.col("count").alias("c")))
    alone = rest.join(single, "tail", "left")
    parts.append(alone.select("n", "gram", (F.col("units") + _units(F.coalesce("c", F.lit(1))) - round(math.log(total) * UNIT)).alias("units")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scores(docs: DataFrame, tokenizer: str, least: int = 1, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", model: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_score (the sum of natural logarithms) and mean_log_score of every row.

    The counts are those of docs, or model, which counts() made of other documents with the
    same tokenizer and order. A text without tokens, or a null, has score 0 and a null mean. Rows
    that share an id, or have none, stay apart; other columns are not looked at.
    """
    grams = postings(docs, tokenizer, order, doc_id, text)
    own = counts(grams)
    found = stored(gram_scores(own.where("asked").select("n", "gram"), own if model is None else model, order, least), "scores")
    # a chunk has an n-gram once, so a very common one has as many rows as there are chunks, and its texts stay with their chunks
    some = grams.where((F.col("n") > 0) & (F.size("rows") > 0))
    by_chunk = some.select("chunk", "n", "gram").join(found, ["n", "gram"])
    asked = some.select("chunk", "n", "gram", "rows").join(by_chunk, ["chunk", "n", "gram"]).select("chunk", F.explode("rows").alias("row"), "units")
    none = lambda kind: F.lit(None).cast(kind)
    kind = docs.schema[doc_id].dataType.simpleString()
    base = grams.where("n = 0").select("chunk", F.col("gram").cast("int").alias("row"), F.lit(0).cast("long").alias("units"), F.col("count").alias("n_tokens"), "doc")
    rows = base.union(asked.select("chunk", "row", "units", none("long"), none(kind)))
    sums = rows.groupBy("chunk", "row").agg(F.max("doc").alias(doc_id), F.max("n_tokens").alias("n_tokens"), F.sum("units").alias("units"))
    log_score = F.col("units") / F.lit(float(UNIT))
    return sums.select(doc_id, "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score"))


def op5_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Score of every document by the counts of all documents; every counted n-gram counts, those found once too."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, public_tokenizers.path("word_bpe_49k.json"))

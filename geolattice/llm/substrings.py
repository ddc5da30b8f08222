"""Removal of long strings that occur more than once, by prefix-free parsing.

A rolling hash over short grams triggers the phrases: a string of SIZE bytes belongs
to the phrase of the gram in it whose hash is least (the leftmost of equals), which
its own bytes decide. Neighbouring phrases overlap by SIZE - 1 bytes, so every
string lies in exactly one phrase of its text, and equal strings lie at equal places
of their grams' phrases. The parse counts phrases; a phrase found twice is repeated
as a whole. Of the others only those are looked at that share a core, the bytes all
their strings have, with a different phrase. These make up the dictionary, whose
suffixes are ranked by prefix doubling; strings of equal rank are repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored, tidy, with_groups

SIZE = 200
GRAM = 8
#: Strings whose gram starts at 0..SPLIT-1 and at SPLIT.. bytes into them are parted, so that cores are long.
SPLIT = 97
#: Bytes of text that are parsed at a time, or one text.
PIECE = 512 << 10
#: Most bytes whose grams are ranked together: PLACE bits hold a place, the others a hash. Longer texts are parsed part by part.
PLACE, PART = 28, 1 << 26
#: Phrases of the dictionary that one bin holds on average, and the most with one core that go to one bin.
BIN, GROUP = 1_024, 1_024

KEYS = ["doc", "key"]


def row_key(doc_id: str, text: str):
    """Tells rows that share an id apart; equal rows are found twice and get the same result."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def parse(data: bytes, starts, size: int = SIZE, split: int = SPLIT):
    """The phrases of texts that lie end to end in data, each from its place in starts to the next.

    Returns arrays: first and last string start of each phrase, and core start and stop.
    Beyond PART bytes strings are dealt out by where they start, which only parts a phrase
    in two where two parts meet; these share their core.
    """
    import numpy as np

    empty = (np.zeros(0, np.int64),) * 4
    n = len(data) - size + 1
    if n <= 0:
        return empty
    if n > PART:
        starts, found = np.asarray(starts, np.int64), []
        for a in range(0, n, PART):
            inner = starts[(starts > a) & (starts < a + PART + size - 1)] - a
            found.append([x + a for x in parse(data[a : a + PART + size - 1], np.append(0, inner), size, split)])
        return tuple(map(np.concatenate, zip(*found)))
    raw = np.frombuffer(data, np.uint8)
    grams = np.empty(len(data) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        part = grams[k::GRAM]
        part[:] = raw[k : k + GRAM * len(part)].view("<u8")
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.uint64(PLACE)
    grams >>= place
    grams <<= place
    grams |= np.arange(len(grams), dtype=np.uint64)
    width, least = 1, grams
    wide = size - GRAM + 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: width - wide], least[wide - width :])
    anchor = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    starts = np.asarray(starts, np.int64)
    ends = np.append(starts[1:], len(data)) - size  # the last string of each text
    new = np.ones(n, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[starts < n]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, ends[text])
    good = last >= first
    first, last = first[good], last[good]
    at = anchor[first]
    near, far = np.maximum(first, at - split + 1), np.minimum(last, at - split)
    x, y = near <= last, first <= far
    return (
        np.concatenate([near[x], first[y]]),
        np.concatenate([last[x], far[y]]),
        np.concatenate([at[x], at[y] - split]),
        np.concatenate([at[x] + size - split + 1, at[y] + GRAM]),
    )


def phrases(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, key, start, n, core, whole: the phrases of all texts with hashes of their cores and of all their bytes."""
    out = T.StructType(
        [
            T.StructField("doc", docs.schema[doc_id].dataType),
            *(T.StructField(k, t) for k, t in (("key", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()), ("core", T.LongType()), ("whole", T.LongType()))),
        ]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        def rows(docs, keys, texts):
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(lengths) - lengths
            data = b"".join(texts)
            first, last, lo, hi = parse(data, starts)
            view = memoryview(data)
            core = [digest(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
            # the same bytes around another gram, or the same gram elsewhere in them, are another phrase
            whole = [digest(view[a : b + SIZE], s) for a, b, s in zip(first.tolist(), last.tolist(), (lo - first).tolist())]
            text = np.searchsorted(starts, first, "right") - 1
            take = pa.array(text)
            unsigned = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [docs.take(take), keys.take(take), pa.array((first - starts[text]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), unsigned(core), unsigned(whole)],
                out.names,
            )

        for batch in batches:
            ids, keys, column = batch.column(0), batch.column(1), batch.column(2)
            held, total, since = [], 0, 0
            for i in range(batch.num_rows):
                x = (column[i].as_py() or "").encode()
                if total and total + len(x) > PIECE:
                    yield rows(ids.slice(since, i - since), keys.slice(since, i - since), held)
                    held, total, since = [], 0, i
                held.append(x)
                total += len(x)
            if held:
                yield rows(ids.slice(since), keys.slice(since), held)
        tidy()

    return docs.select(F.col(doc_id).alias("doc"), row_key(doc_id, text).alias("key"), text).mapInArrow(run, out)


def ranks(data: bytes, size: int = SIZE):
    """For each string start in data, the rank of the size bytes there among all: suffix order by prefix doubling."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    words = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        part = words[k::8]
        part[:] = raw[k : k + 8 * len(part)].view(">u8")
    rank, width = np.unique(words, return_inverse=True)[1].astype(np.uint64), 8
    while width < size:
        step = min(width, size - width)
        pair = rank[:-step] << np.uint64(32) | rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        width += step
    return rank


def _texts(docs: DataFrame, doc_id: str, text: str, found: DataFrame, name: str, by: str) -> DataFrame:
    """docs with the list name of found (doc, key, list), joined by id and key; the key is called by."""
    (other,) = fresh([*docs.columns, name, by], "doc")
    found = found.select(F.col("doc").alias(other), F.col("key").alias(f"{by}2"), F.col("list").alias(name))
    base = docs.withColumn(by, row_key(doc_id, text))
    return base.join(found, (F.col(by) == F.col(f"{by}2")) & F.col(doc_id).eqNullSafe(F.col(other)), "left").drop(f"{by}2", other)


def dictionary_repeats(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, key, lo, hi: byte spans that strings of chosen phrases cover which occur in another of them.

    chosen: doc, key, start, n, core, n_found, big. Phrases are dealt into bins by core; the
    dictionary of a bin is ranked as a whole. Where more phrases than GROUP have one core
    (big), their strings are dealt out one by one by hash and counted instead.
    """
    schema = T.StructType([chosen.schema["doc"], chosen.schema["key"], T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
    lists = chosen.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "n", "core", "n_found", "big")).alias("list"))
    some, key = fresh([doc_id, text], "some", "key")
    rows = _texts(docs.select(doc_id, text), doc_id, text, lists, some, key).where(F.col(some).isNotNull())
    rows = rows.select(F.col(doc_id).alias("doc"), F.col(key).alias("key"), F.encode(text, "UTF-8").alias("data"), F.explode(some).alias("s")).select("doc", "key", "data", "s.*")
    rows = rows.select("doc", "key", "start", "n", "core", "n_found", "big", F.substring("data", F.col("start") + 1, F.col("n") + (SIZE - 1)).alias("bytes"))
    rows = stored(rows, "dictionary")
    bins = max(1, -(-rows.count() // BIN))

    def spans(flags, start):
        import numpy as np

        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        return [(start + int(a), start + int(b) - 1 + SIZE) for a, b in zip(edge[::2], edge[1::2])]

    def rank_bin(key, table):
        import numpy as np
        import pyarrow as pa

        texts = table.column("bytes").to_pylist()
        n, start, found = (table.column(c).to_numpy() for c in ("n", "start", "n_found"))
        at = np.cumsum([0, *map(len, texts)])[:-1]
        rank = ranks(b"".join(texts))
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[of]
        repeated = np.bincount(rank[place].astype(np.int64))[rank[place].astype(np.int64)] > 1
        ends = np.cumsum(n)
        got = [(i, *s) for i in np.flatnonzero(found == 1) for s in spans(repeated[ends[i] - n[i] : ends[i]], int(start[i]))]
        take = pa.array([g[0] for g in got], pa.int64())
        return pa.table([table.column("doc").take(take), table.column("key").take(take), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=schema.names)

    small = rows.where("NOT big").withColumn("bin", F.pmod(F.xxhash64("core"), F.lit(bins)))
    near = small.groupBy("bin").applyInArrow(rank_bin, schema)

    strings = rows.where("big").select("doc", "key", "start", "n_found", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    string = F.substring("bytes", F.col("i") + 1, SIZE)
    strings = strings.select("doc", "key", (F.col("start") + F.col("i")).alias("at"), "n_found", F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(1), string).alias("h2"))
    twice = with_groups(stored(strings, "strings"), ["h1", "h2"], ["doc", "key"], {"times": (F.count("*"), F.sum)}, "times > 1")
    single = twice.where("n_found = 1").select("doc", "key", F.col("at").alias("lo"), (F.col("at") + SIZE).alias("hi"))
    return near.union(single)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, key, list: for each text with repeats, the byte spans that repeated strings cover (they may overlap)."""
    rows = stored(phrases(docs, doc_id, text), "phrases")
    # kept as a table, so that a core that very many phrases share can be split in the join
    cores = stored(rows.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), "cores")
    rows = stored(rows.join(cores, "core"), "candidates")
    place = F.struct("doc", "key", "start", "n")
    times = {"n_found": (F.count("*"), F.sum), "p": (F.min(place), F.min)}
    rows = stored(with_groups(rows, ["core", "whole"], ["doc", "key"], times), "counted")
    whole = rows.where("n_found > 1").select(*KEYS, F.col("start").alias("lo"), (F.col("start") + F.col("n") + (SIZE - 1)).alias("hi"))
    # the parse's phrases, each by its first place
    entries = stored(rows.where(F.col("p") == place).select("core", "whole", "n_found", "p").dropDuplicates(["core", "whole"]), "entries")
    many = {"c": (F.count("*"), F.sum), "least": (F.min("n_found"), F.min)}
    chosen = with_groups(entries, ["core"], ["whole"], many, "c > 1 AND least = 1")
    chosen = chosen.select("p.*", "core", "n_found", (F.col("c") > GROUP).alias("big"))
    part = dictionary_repeats(docs, chosen, doc_id, text)
    return whole.union(part).groupBy(*KEYS).agg(F.collect_set(F.struct("lo", "hi")).alias("list"))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """docs with the columns n_bytes, n_removed, n_spans and kept, the bytes that no repeated string covers.

    Texts are judged as UTF-8; a null text is empty. Strings of SIZE bytes within one text
    count, wherever else they start, and every occurrence goes. Columns of docs with the
    new names give way. With as_text kept is a string, without the parts of characters that
    a cut leaves.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    names = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    key, found = fresh([*names, *made], "key", "spans")
    rows = _texts(docs, doc_id, text, repeated_spans(docs, doc_id, text), found, key)
    out = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        at = names.index(text)
        # a thousand texts at a time, so that a worker holds few of them twice
        for batch in (b.slice(k, 1_000) for b in batches for k in range(0, b.num_rows, 1_000)):
            made = [[], [], [], []]
            for x, spans in zip(batch.column(at), batch.column(len(names))):
                data, merged = (x.as_py() or "").encode(), []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans.as_py() or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                kept, last = [], 0
                for lo, hi in merged:
                    kept.append(data[last:lo])
                    last = hi
                kept.append(data[last:])
                kept = b"".join(kept)
                size = len(data) - len(kept)
                kept = kept.decode("utf-8", "ignore") if as_text else kept
                for column, value in zip(made, (len(data), size, len(merged), kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(m, pa.int64()) for m in made[:3]), pa.array(made[3], pa.string() if as_text else pa.binary())], out.names)
        tidy()

    return rows.select(*(F.col(f"`{c}`") for c in names), found).mapInArrow(run, out)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document's bytes, as counts and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Packing token sequences into windows by the sum-of-squares rule.

A window's level is the number of tokens it holds; count[h] is the number of
open windows at level h. An arriving piece goes to the level, or to a new
window, for which the sum of count[h]**2 over partly filled levels is least.
"""

from __future__ import annotations

import struct
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters, letters, packed
from .common import tidy, worker_state

#: Entries of a worker's table of recent words; when full it starts anew.
RECENT = 800_000
#: Windows that may be open at once in a task; beyond it the emptiest are cut up to fill the others.
OPEN = 2_048


class WordTokens:
    """Ids of texts by a tokenizer that lowers case, composes accents and drops white space.

    Such a tokenizer parts words at white space and between letters and marks, so it works
    word by word, with a table of recent words.
    """

    def __init__(self, path: str, most: int = RECENT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.recent: dict[str, bytes] = {"": b""}
        self.most = most
        self.letter = {chr(b): x for b, x in enumerate(byte_letters())}
        self.ends = {c: packed(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ".,;:!?"}

    def merged(self, word: str) -> bytes | None:
        """Ids of a word of Latin-1 letters, perhaps before a punctuation mark; None for others."""
        end = self.ends.get(word[-1:], b"")
        word = word[:-1] if end else word
        if not letters(word):
            return None
        lower = word.lower()
        known = self.recent.get(lower)
        if known is None:
            plain = lower if lower.isascii() else "".join(map(self.letter.__getitem__, lower.encode().decode("latin-1")))
            known = self.recent[lower] = packed([t.id for t in self.tokenizer.model.tokenize(plain)])
        return known + end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; a null text has none."""
        parts = [x.replace("\n", " ").split(" ") if x else [""] for x in texts]
        if len(self.recent) > self.most:
            self.recent = {"": b""}
        recent, rest = self.recent, []
        for word in set().union(*parts).difference(recent):
            ids = self.merged(word)
            if ids is None:
                rest.append(word)
            else:
                recent[word] = ids
        for k in range(0, len(rest), 5_000):
            some = rest[k : k + 5_000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                recent[word] = packed(e.ids)
        return [b"".join(map(recent.__getitem__, x)) for x in parts]


class Packer:
    """Windows of one task. Pieces are (document, start, length) with their ids."""

    def __init__(self, size: int):
        import numpy as np

        self.size, self.np = size, np
        self.count = np.zeros(size + 1, np.int64)  # levels 0 and size stay 0
        self.levels: list[list[list]] = [[] for _ in range(size + 1)]
        self.open = 0

    def place(self, piece: tuple, length: int):
        """Puts a piece somewhere; yields the window if that fills it."""
        np, count, size = self.np, self.count, self.size
        if length == size:
            yield [piece]
            return
        # moving a window from h to h + length changes the sum by 2 * (count[h + length] - count[h] + 1)
        cost = count[length:size] - count[: size - length]
        cost = np.append(cost, 0 - count[size - length])  # a full window counts no more
        cost[0] = count[length]
        cost[1:][count[1 : size - length + 1] == 0] = 1 << 60
        cost[0] *= 2
        cost[1:-1] *= 2
        cost[-1] *= 2
        # a new window adds 2 * count + 1, a move 2 * (difference) + 2, filling up 1 - 2 * count
        cost[0] += 1
        cost[1:-1] += 2
        cost[-1] += 1
        best = int(cost.argmin())
        if best:
            window = self.levels[best].pop()
            count[best] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        level = best + length
        if level == size:
            yield window
            return
        self.levels[level].append(window)
        count[level] += 1
        self.open += 1
        if self.open > OPEN:
            yield from self.pour(OPEN // 2)

    def pour(self, keep: int):
        """Cuts the pieces of the emptiest windows to fill the fullest, until at most keep are open."""
        level = self.size - 1
        low = 1
        while self.open > keep and self.open > 1:
            while not self.levels[level]:
                level -= 1
            while not self.levels[low]:
                low += 1
            full = self.levels[level].pop(0)
            source = self.levels[low].pop(0)
            self.count[level] -= 1
            self.count[low] -= 1
            self.open -= 2
            gap, rest = self.size - level, low
            while gap and source:
                doc, start, ids, total = source.pop()
                n = len(ids) // 4
                take = min(n, gap)
                full.append((doc, start, ids[: 4 * take], total))
                if take < n:
                    source.append((doc, start + take, ids[4 * take :], total))
                gap -= take
                rest -= take
            if gap:
                self.levels[self.size - gap].append(full)
                self.count[self.size - gap] += 1
                self.open += 1
                level = self.size - gap
            else:
                yield full
            if rest:
                self.levels[rest].append(source)
                self.count[rest] += 1
                self.open += 1
                low = rest

    def finish(self):
        """The last windows: all full but one, which is parted into powers of two, so nothing is padded."""
        yield from self.pour(1)
        for level in range(1, self.size):
            for window in self.levels[level]:
                part, room = [], 0
                for doc, start, ids, total in window:
                    while ids:
                        if not room:
                            if part:
                                yield part
                            part, room = [], 1 << (level.bit_length() - 1)
                            level -= room
                        take = min(room, len(ids) // 4)
                        part.append((doc, start, ids[: 4 * take], total))
                        ids, start, room = ids[4 * take :], start + take, room - take
                yield part


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", recent: int = RECENT) -> DataFrame:
    """The pieces of all documents, each in its place in a sequence of at most size tokens.

    A document is its ids and then the id end; a null text has no ids of its own. What
    exceeds whole sequences is placed by the sum-of-squares rule within its task, without
    any shuffle; what is left open at a task's end is cut so that every sequence is full or
    a power of two long. Where more than OPEN windows of a task are open at once, as with
    pieces that can't be paired, the emptiest are cut up to fill the fullest until half as
    many are, which bounds a task's memory; no id is lost or padded by it. Rows with equal or null ids are packed like any others. Columns:
    doc_id, start, length, ids, doc_tokens, sequence_id, offset. recent bounds a worker's
    table of recent words (about 200 bytes each).
    """
    out = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens = worker_state(("word", tokenizer, recent), lambda: WordTokens(tokenizer, recent))
        packer, last = Packer(size), struct.pack("<I", end)
        sequence, rows, held = TaskContext.get().partitionId() << 32, [], 0
        id_type = None

        def table():
            lengths = [len(r[2]) // 4 for r in rows]
            ends = np.cumsum([0, *lengths])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(r[2] for r in rows), "<i4"), pa.int32()))
            columns = [pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int64()), pa.array(lengths, pa.int64())]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)]
            return pa.RecordBatch.from_arrays([*columns, ids], out.names)

        def keep(windows):
            nonlocal sequence, held
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    rows.append((doc, start, ids, total, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
                held += offset

        for batch in batches:
            id_type = batch.schema.field(0).type
            n = batch.num_rows
            for k in range(0, n, 500):
                part = batch.slice(k, 500)
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist())):
                    ids += last
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        x = ids[4 * start : 4 * (start + size)]
                        keep(packer.place((doc, start, x, total), len(x) // 4))
                if held > 1 << 20:
                    yield table()
                    rows, held = [], 0
        keep(packer.finish())
        if rows:
            yield table()
        tidy()

    return docs.select(doc_id, text).mapInArrow(run, out)


def crc32_of_ids(rows: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """rows with the unsigned CRC-32 of each id array's little-endian 32-bit words instead of the array."""
    keep = [c for c in rows.columns if c not in (ids, name)]
    out = T.StructType([*rows.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(len(keep))
            data = column.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            ends = (column.offsets.to_numpy() * 4).tolist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(sums, pa.int64())], [*keep, name])

    return rows.select(*keep, ids).mapInArrow(run, out)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, ids as checksums."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = crc32_of_ids(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

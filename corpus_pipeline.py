"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's docs.
"""

import uuid

from pyspark.sql import functions as F

from geolattice.llm.common import shared_dir
from geolattice.llm.lines import drop_repeated_lines
from geolattice.llm.packing import crc32_of_ids, pack
from geolattice.llm.quality import keep_good
from geolattice.llm.shingles import one_of_each
from geolattice.llm.substrings import drop_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs, text):
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the rules, or whose host does, go."""
    return keep_good(docs.select(*COLUMNS))


def line_dedup(spark, docs, sf_dir):
    """Lines of later three-line copies go from the texts; every document stays."""
    rows = drop_repeated_lines(docs.select(*COLUMNS))
    return _with_text(rows, F.col("text"))


def simhash_dedup(spark, docs, sf_dir):
    """Of documents that are near copies by five-word shingles, the one with the smallest id stays.

    The SimHash index and, beyond its reach, least hashes propose the pairs; a similarity of
    the shingle sets of 0.8 or more links them. Documents without an id come last.
    """
    return one_of_each(docs.select(*COLUMNS), words=5, least=0.8)


def suffix_dedup(spark, docs, sf_dir):
    """Bytes in repeated 200-byte strings go from the texts, with any part of a character they leave."""
    rows = drop_repeats(docs.select(*COLUMNS), as_text=True)
    return _with_text(rows, F.when(F.col("text").isNotNull(), F.col("kept")))


def packing(spark, docs, sf_dir):
    """The pieces of all documents in sequences of 2048 tokens, ids as checksums."""
    import public_tokenizers

    rows = crc32_of_ids(pack(docs, public_tokenizers.path("word_bpe_49k.json"), recent=100_000))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packing),
]

#: Packing and byte-wise removal can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir; between stages the rows lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/tables/stage{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

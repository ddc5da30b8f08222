"""Quality rules with host verdicts, by DataFrame functions only.

Each document is measured on its own; failures are then counted by host, each
host's rate is shrunk towards the mean of all hosts by a beta prior fitted to
them, and documents of hosts whose shrunk rate is too high are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, fresh, let, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Up to so many host verdicts (some MB) are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000


def words_of(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that is found twice or more in the same text."""

    def covered(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(rows):
            same = lambda x, i: F.coalesce(F.get(rows, i)["h"] == x["h"], F.lit(False))
            found = F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1))
            starts = F.array_sort(F.transform(found, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
            add = lambda a, p: F.struct((p + window).alias("end"), (a["total"] + F.least(F.lit(window), p + window - a["end"])).alias("total"))
            return F.aggregate(starts, start, add)["total"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, count))

    def windows(w):
        by_word = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))
        return F.when(F.size(w) < window, F.lit(0)).otherwise(let(let(F.transform(w, lambda x: F.xxhash64(x)), by_word), covered))

    return let(words, windows)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES; columns of docs with those names give way.

    A null or empty text has no words and fails. A text fails with under 20 words, or
    where over 30 % of its words lie in repeated 8-word windows.
    """
    docs = docs.drop(*MEASURES)
    (both,) = fresh([*docs.columns, *MEASURES], "sizes")
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    sizes = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    out = docs.withColumn(both, sizes).withColumns(
        {
            "n_words": F.col(both)["n"],
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": repeats.cast("long"),
            "n_repeat_words": F.col(both)["r"],
        }
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(both)


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """One row for each host that fails: host, n_host, n_host_failed and host_rate, its shrunk rate.

    The prior is a beta distribution fitted by moments: its mean is the failure rate of all
    documents; the variance of host rates, weighted by documents, less what chance alone
    would make it, gives its strength mean * (1 - mean) / variance - 1, which is held between
    0.001 and the number of documents. A host fails if (failures + mean * strength) /
    (documents + strength) exceeds limit. Documents without a host count for none.
    """
    hosts = cut(
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_host"), F.count_if("base_failed").alias("n_host_failed"))
    )
    n, f = F.col("n_host"), F.col("n_host_failed")
    total, failed, squares, count = hosts.agg(F.sum(n), F.sum(f), F.sum(f * f / n), F.count("*")).first()
    mean, total = (failed or 0) / (total or 1), total or 1
    by_chance = mean * (1 - mean) * count / total
    variance = ((squares or 0.0) / total - mean * mean - by_chance) / (1 - count / total) if count < total else 0.0
    strength = min(float(total), max(0.001, mean * (1 - mean) / variance - 1)) if variance > 1e-9 else float(total)
    rate = (f + F.lit(mean * strength)) / (n + F.lit(strength))
    return hosts.withColumn("host_rate", rate).where(F.col("host_rate") > limit)


def verdicts(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """measured with kept: false if the document or its host fails."""
    name, fails = fresh([*measured.columns, "kept"], "host", "fails")
    bad = hosts.select(F.col("host").alias(name), F.lit(True).alias(fails))
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = measured.drop("kept").join(bad, F.col(host) == F.col(name), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col(fails).isNull()).drop(name, fails)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents that neither fail the rules nor belong to a failing host, with their own columns.

    Texts are measured once: rows and verdicts are kept as a table, without the texts of
    documents that fail on their own. Null and empty texts fail.
    """
    (own,) = fresh([*docs.columns, *MEASURES, "kept"], "own")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(own), F.col(text), F.col(host))
    rows = measure(rows, text).select(F.when(~F.col("base_failed"), F.col(own)).alias(own), F.col(host), "base_failed")
    rows = stored(rows, "measured")
    bad = host_verdicts(rows, host, limit)
    return verdicts(rows, bad, host).where("kept").select(f"{own}.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; source is the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = cut(measure(docs.select("doc_id", "text", "source")).drop("text"))
    return verdicts(measured, host_verdicts(measured)).select("doc_id", *MEASURES, "kept")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS r(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(n) AS total, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS squares, count(*) AS hosts FROM h),
p AS (SELECT total, mean, CASE WHEN hosts < total THEN (squares - mean * mean - mean * (1 - mean) * hosts / total) / (1 - hosts / total) ELSE 0 END AS v FROM t),
s AS (SELECT mean, CASE WHEN v > 1e-9 THEN least(CAST(total AS DOUBLE), greatest(0.001, mean * (1 - mean) / v - 1)) ELSE CAST(total AS DOUBLE) END AS k FROM p),
bad AS (SELECT source FROM h, s WHERE (f + mean * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept
FROM b
"""

"""Removal of repeated runs of lines, by DataFrame functions only.

Every three consecutive lines of a document that are not blank form a window,
hashed without the blanks around each line. Of windows that are equal anywhere,
the first by document id and place stays; the lines of later ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, let, stored, with_groups

WINDOW = 3


def windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, key, first, last, h1, h2: the windows of all documents; first and last are places of lines."""
    bare = lambda x: F.regexp_replace(x, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("i"), bare(x).alias("x"))), lambda s: s["x"] != "")

    def of(rows):
        at = lambda i, k: F.get(rows, i + k)
        one = lambda i: F.struct(
            at(i, 0)["i"].alias("first"),
            at(i, WINDOW - 1)["i"].alias("last"),
            F.xxhash64(*(at(i, k)["x"] for k in range(WINDOW))).alias("h1"),
            F.xxhash64(F.lit("second"), *(at(i, k)["x"] for k in reversed(range(WINDOW)))).alias("h2"),
        )
        return F.when(F.size(rows) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(rows) - WINDOW), one))

    return docs.select(F.col(doc_id).alias("doc"), row_key(doc_id, text).alias("key"), F.explode(let(lines, of)).alias("w")).select("doc", "key", "w.*")


def row_key(doc_id: str, text: str):
    """Tells rows that share an id apart; equal rows are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, key, spans: for each document with later copies, the first and last line of each."""
    rows = stored(windows(docs, doc_id, text), "windows")
    place = F.struct("doc", "key", "first")
    ends = {"origin": (F.min(place), F.min), "end": (F.max(place), F.max)}
    later = with_groups(rows, ["h1", "h2"], ["doc", "key"], ends, "origin <> end").where(F.col("origin") != place)
    return later.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines of later copies gone from text, and the columns n_lines and n_removed.

    A null text stays null and has no lines; texts of under three lines that are not
    blank stay whole. Rows equal in id and text are one document and get the same result.
    Columns of docs named n_lines or n_removed give way, all others stay.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    doc, key, spans, at, gone = fresh([*names, "n_lines", "n_removed"], "doc", "key", "spans", "at", "gone")
    found = repeated_spans(docs, doc_id, text).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("spans").alias(spans))
    base = docs.withColumn(at, row_key(doc_id, text))
    joined = base.join(found, (F.col(at) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(doc)), "left")
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    rest = lambda x, y: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), y), lambda i: F.get(x, i)), "\n")
    joined = joined.withColumn(gone, covered)
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(let(F.split(F.col(text), "\n"), lambda x: rest(x, F.col(gone)))),
        }
    ).select(*(F.col(f"`{c}`") for c in names), "n_lines", "n_removed")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines of later three-line copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs)


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, lines[i] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE x <> ''),
w AS (SELECT a.doc_id, a.i AS first, c.i AS last, a.x || chr(10) || b.x || chr(10) || c.x AS g
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.r = a.r + 1 JOIN f c ON a.doc_id = c.doc_id AND c.r = a.r + 2),
later AS (SELECT doc_id, first, last FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text,
                count(*) AS n_lines, count(gone.i) AS n_removed
         FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

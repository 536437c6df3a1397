"""Line de-duplication by overlapping three-line windows.

The non-blank lines of a text are normalised (lower case, white space runs
as one space, trimmed).  Every run of three consecutive ones is hashed; a
text with fewer has one window of all its lines.  A window found more than
once in the corpus keeps its first occurrence, by (doc_id, line number); the
lines covered by any later occurrence are removed (covered positions of
overlapping windows merge).

Defined results: null text stays null, an empty text stays empty; rows with a
null ``doc_id`` are passed through and take no part; rows that repeat a
``doc_id`` are one document when their text is the same (both keep what the
first occurrence keeps) and are ordered by text hash when it differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import GAP, WORD

WINDOW_LINES = 3


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, GAP, " ")))


def windows(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, variant, start, lines, h): each window's hash, first line
    number and the numbers of its lines.  ``variant`` tells texts of one
    doc_id apart."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("variant"), F.split("text", "\n").alias("raw"))
    # (number, hash) of the non-blank lines, then runs of consecutive ones
    rows = rows.select("doc_id", "variant", F.expr("transform(raw, (x, i) -> struct(i as n, x as x))").alias("raw"))
    rows = rows.select("doc_id", "variant", F.filter("raw", lambda r: r["x"].rlike(WORD)).alias("raw"))
    rows = rows.select("doc_id", "variant", F.transform("raw", lambda r: F.struct(r["n"].alias("n"), F.xxhash64(normalised(r["x"])).alias("h"))).alias("l"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("l") - (size - 1), F.lit(1))), lambda i: F.slice("l", i, F.lit(size)))
    runs = rows.select("doc_id", "variant", F.explode(runs).alias("run"))
    return runs.select("doc_id", "variant", F.element_at("run", 1)["n"].alias("start"), F.col("run.n").alias("lines"), F.xxhash64("run.h").alias("h"))


def repeated_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, variant, removed): numbers of the lines that a later occurrence covers."""
    found = windows(docs, size)
    place = F.struct("doc_id", "variant", "start")
    first = (found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where(F.col("first") < F.col("last")).select("h", "first"))
    later = found.join(first, "h").where(place > F.col("first"))
    return (later.select("doc_id", "variant", F.explode("lines").alias("n")).distinct()
            .groupBy("doc_id", "variant").agg(F.collect_list("n").alias("removed")))


def remove_repeated_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """The input rows and columns with ``text`` less its repeated lines, and
    ``n_removed_lines`` (long; replaces an input column of that name)."""
    marks = repeated_lines(docs, size)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_variant"))
    joined = rows.join(marks, (F.col("row_id") == F.col("doc_id")) & (F.col("row_variant") == F.col("variant")), "left")
    split = joined.select("row", "removed", F.when(F.col("removed").isNotNull(), F.split("row.text", "\n")).alias("raw"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), "removed")  # keeps the order
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(F.col("raw"), i + 1)), "\n"))
    cols = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "n_removed_lines"]
    return split.select(*cols, F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed_lines"))

"""Quality rules over words and lines, with cross-document line frequency.

Base counts of a text are built-in array functions on the text alone.  The
method then looks across documents: every line that holds a word is
normalised (lower case, white space runs as one space, trimmed) and hashed,
and the distinct documents of each host that hold it are counted.  Lines held
by more than ``max_docs_per_host`` of them are removed, and a document that
loses more than ``max_lost_percent`` of its words that way is rejected as
depleted.  ``cleaned`` returns the texts without these lines (blank lines
stay); ``apply_rules`` is the same without the text.  The host of a document
is its ``source``.

Defined results: null text counts as empty (0 words, so base_failed) and stays null; a null
source is a host of its own; rows that repeat a (doc_id, text) count once as
a document of a host and each get their result; rows with a null doc_id are
told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import GAP, WORD
from donorlens.llm.lines import normalised

SYMBOLS = "#*$%&|<>"  # fixed value


def doc_key() -> Column:
    """Tells documents apart: doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))


def base_counts(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, host, doc (key), text, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    ids = ["doc_id", "host", "doc", "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"),
                       doc_key().alias("doc"), "text", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select(
        *ids, F.filter(F.split("t", GAP), lambda w: w != "").alias("w"), _word_lines("t").alias("raw"),
        F.length(F.regexp_replace("t", GAP, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counts = [*ids, "word_chars", "n_symbols"]
    gram = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        *counts, F.size("w").cast("long").alias("n_words"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, gram).alias("grams"))
    counts += ["n_words", "n_dup_lines"]
    # (hash, position) sorted, only where some window occurs twice
    order = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*counts, F.when(F.size(F.array_distinct("grams")) < F.size("grams"), order).alias("s"))
    twice = F.filter("s", lambda x, j: (x["h"] == F.get("s", j - 1)["h"]) | (x["h"] == F.get("s", j + 1)["h"]))
    rows = rows.select(*counts, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"))
    # words under the windows at positions p: three, less the overlap with the next window
    under = F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(under, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.select(*counts, covered.alias("n_repeat_words")).withColumn("base_failed", failed)


def _word_lines(text: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc, host, pos, h, words): every line with a word, its number in the
    text, its hash and its words; rows that repeat a document give its lines once."""
    rows = docs.select(doc_key().alias("doc"), F.col("source").cast("string").alias("host"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(WORD)).select("doc", "host", "pos", F.xxhash64(normalised(F.col("line"))).alias("h"),
                       F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")).distinct()


def frequent_lines(lines: DataFrame, max_docs_per_host: int) -> DataFrame:
    """(hot_host, hot_h): lines that more documents of the host hold."""
    held = lines.select("host", "h", "doc").distinct()
    return (held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
            .where(F.col("n_docs") > max_docs_per_host).select(F.col("host").alias("hot_host"), F.col("h").alias("hot_h")))


def removed_lines(docs: DataFrame, max_docs_per_host: int) -> DataFrame:
    """(lost_doc, lost_host, lost, removed): words of a document in frequent
    lines, and the numbers of these lines."""
    lines = document_lines(docs)
    hot = frequent_lines(lines, max_docs_per_host)
    return (lines.join(hot, F.col("host").eqNullSafe(F.col("hot_host")) & (F.col("h") == F.col("hot_h")))
            .groupBy("doc", "host").agg(F.sum("words").alias("lost"), F.collect_list("pos").alias("removed"))
            .select(F.col("doc").alias("lost_doc"), F.col("host").alias("lost_host"), "lost", "removed"))


def cleaned(docs: DataFrame, max_docs_per_host: int = 100, max_lost_percent: int = 50) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, n_removed_words,
    kept, and ``text`` less its frequent lines."""
    base = base_counts(docs)
    lost = removed_lines(docs, max_docs_per_host)
    out = base.join(lost, (F.col("doc") == F.col("lost_doc")) & F.col("host").eqNullSafe(F.col("lost_host")), "left")
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    depleted = lost_words * 100 > F.col("n_words") * max_lost_percent
    out = out.withColumn("raw", F.when(F.col("removed").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), "removed")  # keeps the order
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(F.col("raw"), i + 1)), "\n"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      lost_words.alias("n_removed_words"), (~F.col("base_failed") & ~depleted).alias("kept"), text.alias("text"))


def apply_rules(docs: DataFrame, max_docs_per_host: int = 100, max_lost_percent: int = 50) -> DataFrame:
    """The rows of ``cleaned`` without their text."""
    return cleaned(docs, max_docs_per_host, max_lost_percent).drop("text")

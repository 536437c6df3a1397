"""Corpus preparation: quality filter, line dedup, near-duplicate removal,
source mixing and byte-level BPE encoding over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and reads them back as the next
stage's documents.  All but the last stage return the columns of documents.

* quality: documents the classifier rejects go (labels of held-out rows are
  not learned; rows without text keep the score of the bias).
* line_dedup: text less the lines of repeated three-line windows; a document
  of which no word is left goes.
* near_duplicates: of each component of linked documents the row with the
  smallest doc_id stays; rows that repeat a doc_id collapse into one; rows
  with a null doc_id or without words are linked with nothing and stay.
* source_mixing: every document as often as the mixture takes it (1 to 2).
* byte_bpe: ids of every document, and digests of them and of their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.llm import bpe, jaccard, lines, mixing, quality
from donorlens.llm.common import WORD, find_package, table, written
from donorlens.llm.queries import held_out


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _unpacked(docs: DataFrame) -> list:
    return [F.col(f"row.`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    find_package(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    good = quality.scored_rows(docs, weights).where("score >= 0.5")
    return good.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    deduped = lines.remove_repeated_lines(docs.select(_row(docs), "doc_id", "text"))
    left = deduped.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(WORD))
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    find_package(spark)
    groups = jaccard.NgramJaccardJoin(docs).documents()
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("stay_id")).distinct()
    rows = docs.select(_row(docs), F.col("doc_id").cast("long").alias("id"), "text")
    kept = (rows.join(stay, F.col("id") == F.col("stay_id"), "left_semi")
            .groupBy("id").agg(F.min_by("row", F.struct(F.col("text").isNull(), "text")).alias("row")))
    return kept.select("row").union(rows.where("id IS NULL").select("row")).select(*_unpacked(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    find_package(spark)
    return bpe.digests(bpe.round_trip(docs))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bpe),
]

#: The classifier, the sketches and the tokeniser have no SQL form; the test
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

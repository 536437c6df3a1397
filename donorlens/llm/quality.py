"""Quality classifier: hashed word n-gram logistic regression, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

Features are n-grams over two views of the word sequence: the lower-cased
words (1- and 2-grams) and their forms (1- to 3-grams).  A form is the case,
digits and punctuation of a word and whether it repeats one of the six words
before it, so that form n-grams carry over to words never seen.  Every n-gram
hashes into one of ``2**bits`` weights; its value is its share of the text's
n-grams of that order.

Training takes at most ``train_rows`` labelled documents, those with the
smallest hash of doc_id (a documented bound; the labels alone are sorted for
it).  They are dealt over ``shards`` tasks; each trains by FTRL-proximal for
``epochs`` passes, and the shards' weights are averaged.

Defined results: null or empty text has no n-grams and gets the bias alone;
documents labelled both 0 and 1 do not train; without any usable label the
score is 0.5 for every row; null and repeated doc_id rows are scored row by
row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlens.llm.common import hash_words, mix64, text_bytes

BITS = 18
#: (view, order, value scale): value of an n-gram = scale * count / n-grams of the text.
ORDERS = (("word", 1, 4.0), ("word", 2, 4.0), ("form", 1, 8.0), ("form", 2, 8.0), ("form", 3, 8.0))
LOOK_BACK = 6

_UPPER = np.zeros(256, bool); _UPPER[65:91] = True  # noqa: E702
_LOWERC = np.zeros(256, bool); _LOWERC[97:123] = True; _LOWERC[128:] = True  # noqa: E702
_DIGIT = np.zeros(256, bool); _DIGIT[48:58] = True  # noqa: E702
_STOP = np.zeros(256, bool); _STOP[[ord(c) for c in ".,;:?"]] = True  # noqa: E702
_MARK = ~(_UPPER | _LOWERC | _DIGIT | _STOP); _MARK[:33] = False  # noqa: E702


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[starts]


def word_forms(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Form code of every word (small non-negative integers)."""
    upper, lower = _counts(_UPPER[data], starts, ends), _counts(_LOWERC[data], starts, ends)
    marks, stops = _counts(_MARK[data], starts, ends), _counts(_STOP[data], starts, ends)
    digits = _counts(_DIGIT[data], starts, ends)
    again = np.zeros(len(hashes), bool)
    for back in range(1, LOOK_BACK + 1):
        again[back:] |= hashes[back:] == hashes[:-back]
    case = np.where(upper == 0, 0, np.where(upper > 1, 2, 1)) * 2 + (lower > 0)
    return ((((case * 3 + np.minimum(marks, 2)) * 2 + (stops > 0)) * 2 + (digits > 0)) * 2 + again).astype(np.uint64)


def features(data: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Weight numbers of the n-grams of one text, an array for each of ORDERS."""
    hashes, starts, ends = hash_words(data)
    forms = mix64(word_forms(data, hashes, starts, ends) + np.uint64(1 << 40))
    out = []
    for k, (view, order, _) in enumerate(ORDERS):
        base = hashes if view == "word" else forms
        n = len(base) - order + 1
        if n <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        gram = np.full(n, k + 1, np.uint64)
        for j in range(order):
            gram = mix64(gram * np.uint64(31) + base[j: j + n])
        out.append((gram >> np.uint64(64 - bits)).astype(np.int64))
    return out


def sparse_vector(data: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers (distinct) and values of one text."""
    index, value = [], []
    for grams, (_, _, scale) in zip(features(data, bits), ORDERS, strict=True):
        index.append(grams)
        value.append(np.full(len(grams), scale / max(len(grams), 1)))
    index, value = np.concatenate(index), np.concatenate(value)
    distinct, place = np.unique(index, return_inverse=True)
    return distinct, np.bincount(place, weights=value, minlength=len(distinct))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """FTRL-proximal weights (the bias last)."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, size - 1), np.append(value, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - label) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[i] = ni + g * g
    live = np.abs(z) > l1
    w[live] = (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return w


def _train_shard(bits: int, epochs: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending")])
        labels = group.column("label").to_pylist()
        rows = [(*sparse_vector(data, bits), float(labels[k])) for k, data in text_bytes(group.column("text"))]
        weights = ftrl(rows, bits, epochs).astype("<f4").tobytes()
        return pa.table({"rows": pa.array([len(rows)], pa.int64()), "weights": pa.array([weights], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = 8192, shards: int = 8,
          epochs: int = 3, bits: int = BITS) -> np.ndarray | None:
    """Weights learned from ``labels`` (doc_id, quality) rows where ``usable``
    (an expression over doc_id) holds; None without any."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(usable)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most"))
    rank = F.xxhash64(F.lit(41), "doc_id")
    chosen = (marks.select("doc_id", "label", rank.alias("rank")).orderBy("rank", "doc_id").limit(train_rows)
              .select(F.col("doc_id").alias("of"), "label", "rank"))
    # of rows that share a doc_id the least text learns, so a label is one row at most
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))  # at most train_rows narrow rows
            .groupBy("of", "label", "rank").agg(F.min("text").alias("text"))
            .select(F.pmod("rank", F.lit(shards)).alias("shard"), "rank", "label", "text"))
    parts = rows.groupBy("shard").applyInArrow(_train_shard(bits, epochs), "rows long, weights binary").collect()  # one row a shard
    total = sum(p["rows"] for p in parts)
    if not total:
        return None
    return sum(np.frombuffer(p["weights"], "<f4").astype(np.float64) * (p["rows"] / total) for p in parts)


def text_score(data: np.ndarray, weights: np.ndarray, bits: int) -> float:
    dot = weights[-1]
    for grams, (_, _, scale) in zip(features(data, bits), ORDERS, strict=True):
        if len(grams):
            dot += scale / len(grams) * weights[grams].sum()
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -30, 30)))


def _score_batches(weights: np.ndarray | None, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1) if weights is None else weights.astype(np.float64)
        for batch in batches:
            row = batch.column("row")
            scores = [text_score(data, w, bits) for _, data in text_bytes(row.field(row.type.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], ["row", "score"])

    return run


def scored_rows(docs: DataFrame, weights: np.ndarray | None, bits: int = BITS) -> DataFrame:
    """The input rows and columns with ``score``, the probability of label 1
    (replaces an input column of that name)."""
    names = [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    small = None if weights is None else weights.astype("<f4")  # 1 MB of weights travel with the tasks
    out = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score_batches(small, bits), out).select(*[F.col(f"row.`{c}`") for c in names], "score")


def score(docs: DataFrame, weights: np.ndarray | None, bits: int = BITS) -> DataFrame:
    """(doc_id, score), row by row.  Only the text goes to Python with its id."""
    return scored_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, bits).select("doc_id", "score")

"""Importance resampling towards a target distribution.

*Weights.*  Features are runs of 1 to ``longest`` words (``longest`` 1: words),
hashed into ``buckets``.  A bucket's gain is the log ratio of its smoothed
share among the target texts and among the documents, in thousandths.  The
gains are one array (``buckets`` integers, a fixed size); a document's weight
is the sum of the gains of its features, read from that array.  Feature counts
are summed inside each task before they are shuffled.

*Score.*  Weight plus Gumbel noise from a hash of seed and doc_id: the rows of
highest scores are a draw without replacement, in proportion to the weights.

*Ranks.*  Documents with at least ``min_words`` words are sorted by (score
descending, doc_id ascending, null last) with a radix sort from the least
significant digit on.  Every pass is a stable counting sort over blocks of the
current order: rows per (digit, block) are counted, prefix sums over them give
the place where each block's rows of a digit start, and the row's number
within (digit, block) makes that its destination.  Digits have ``DIGIT_BITS``
bits, and there are at most ``MAX_BLOCKS`` blocks of at least ``BLOCK_ROWS``
rows, so no task holds more than the rows of one block, also where all rows
share a digit.  The last destinations are the ranks.

Defined results: null or empty texts have no features and weight 0; a null
doc_id has the empty text in the hash and ranks after equal scores; rows that
repeat a doc_id are ranked one after the other, in any order; texts are read
in pieces of about a megabyte, so very long ones need no more memory; empty
tables give no rows (an empty target still gives gains); extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import text_bytes, written

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
DIGIT_BITS = 11
BLOCK_ROWS = 256
MAX_BLOCKS = 16_384
PIECE = 1 << 20
SCORED = "doc_id long, n_features long, weight long, n_words long"

# Characters of words: digits, letters and all bytes of code points beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)
_CRC_STEP = _CRC ^ _CRC[0]  # table of the byte-wise update, from the library's own checksums
_LONG_WORD = 24


# --- features -------------------------------------------------------------------

def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Lower-cased pieces of a text, cut between words."""
    at = 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data):
            gaps = np.flatnonzero(~_IN_WORD[data[stop:stop + PIECE]])
            stop = stop + int(gaps[0]) if len(gaps) else min(stop + PIECE, len(data))
            if len(gaps):
                break
        yield _LOWER[data[at:stop]]
        at = stop


def _word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of every span, all spans side by side (long ones alone)."""
    sizes = ends - starts
    out = np.empty(len(starts), np.int64)
    order = np.argsort(-sizes, kind="stable")
    n_long = int((sizes > _LONG_WORD).sum())
    for k in order[:n_long]:
        out[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes())
    rest = order[n_long:]
    begin, size = starts[rest], sizes[rest]
    state = np.full(len(rest), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(rest) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # spans longer than j come first
        state[:n] = _CRC_STEP[(state[:n] ^ data[begin[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out[rest] = state ^ 0xFFFFFFFF
    return out


def feature_buckets(data: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, bucket of every feature) for each piece of a text."""
    if longest == 1:
        for piece in _pieces(data):
            starts, ends = _word_spans(piece)
            yield len(starts), checksums(piece, starts, ends) % buckets
        return
    last: list[bytes] = []  # runs over the border of two pieces
    for piece in _pieces(data):
        starts, ends = _word_spans(piece)
        words = [*last, *(piece[a:b].tobytes() for a, b in zip(starts, ends, strict=True))]
        found = [zlib.crc32(b" ".join(words[i:i + n])) % buckets for n in range(1, longest + 1)
                 for i in range(max(len(last) - n + 1, 0), len(words) - n + 1)]
        yield len(starts), np.array(found, np.int64)
        last = words[-(longest - 1):]


def _count_batches(longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data in text_bytes(batch.column("text")):
                for _, found in feature_buckets(data, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts (one array of ``buckets`` numbers)."""
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + k)) / ((s + 1) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _score_batches(gains: np.ndarray, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_features, weight, n_words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, data in text_bytes(batch.column("text")):
                for words, found in feature_buckets(data, longest, len(gains)):
                    n_words[row] += words
                    n_features[row] += len(found)
                    weight[row] += gains[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_features, weight, n_words))], ["doc_id", "n_features", "weight", "n_words"])

    return run


def noise(seed: int) -> Column:
    """Gumbel noise of a doc_id, in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


# --- radix sort -----------------------------------------------------------------

def _digits(rows: DataFrame) -> list[Column]:
    """Digits of the composite key, least significant first: doc_id ascending (null last), then score descending."""
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("score").alias("c"), F.max("score").alias("d")).first()
    base = 1 << DIGIT_BITS
    out: list[Column] = []

    def split(value: Column, bits: int, null: bool) -> None:
        cuts = range(0, max(bits, 1), DIGIT_BITS)
        for low in cuts:
            digit = F.shiftrightunsigned(value, low).bitwiseAND(F.lit(base - 1)).cast("int")
            out.append(F.coalesce(digit, F.lit(base if null and low == cuts[-1] else 0)))

    wide = (ends["b"] or 0) - (ends["a"] or 0) >= 1 << 62  # a difference could overflow: all 64 bits, sign bit turned
    value = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))) if wide else F.col("doc_id") - F.lit(ends["a"] or 0)
    split(value, 64 if wide else ((ends["b"] or 0) - (ends["a"] or 0)).bit_length(), True)
    split(F.lit(ends["d"] or 0) - F.col("score"), ((ends["d"] or 0) - (ends["c"] or 0)).bit_length(), False)
    return out


def counting_pass(rows: DataFrame, digit: Column, block: Column, order: Column) -> DataFrame:
    """``rows`` with ``place``, their destination (from 0) in a stable sort by the digit."""
    rows = rows.select("*", digit.alias("digit"), block.alias("block"), order.alias("old")).drop("place")
    group = Window.partitionBy("digit", "block").orderBy("old")
    counts = rows.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("digit", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    lower = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # one row a digit
    bases = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("base"))
    starts = inside.join(bases, "digit").select("digit", "block", (F.col("base") + F.col("before")).alias("start"))
    return (rows.withColumn("within", F.row_number().over(group) - 1).join(starts, ["digit", "block"])
            .withColumn("place", F.col("start") + F.col("within")).drop("digit", "block", "old", "within", "start"))


def radix_sorted(rows: DataFrame, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` (doc_id, score, seq: distinct numbers) with ``place``, 0 for the highest score."""
    total = rows.count()
    size = max(block_rows, -(-total // max_blocks))
    n_blocks = max(1, -(-total // size))
    block, order = F.pmod(F.xxhash64("seq"), F.lit(n_blocks)), F.col("seq")  # any order to start with
    for digit in _digits(rows):
        rows = written(counting_pass(rows, digit, block, order), "radix")
        block, order = F.expr(f"place div {size}"), F.col("place")
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             longest: int = LONGEST, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score
    and rank, which is null where the row is not drawn.  ``target`` (text)
    holds the texts to resemble; ``percent`` of the rows of at least
    ``min_words`` words are drawn."""
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = texts.mapInArrow(_score_batches(gains, longest), SCORED)
    scored = written(weighed.select("*", (F.col("weight") + noise(seed)).alias("score"), F.monotonically_increasing_id().alias("seq")), "scored")
    long_enough = F.col("n_words") >= min_words
    ranked = radix_sorted(scored.where(long_enough), block_rows)
    drawn = ranked.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).union(scored.where(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank")))

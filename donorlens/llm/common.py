"""Helpers shared by the corpus operators: tables, shared folder, word hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.session import checkpoint_dir, file_system

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (a cluster gets it by --py-files or an installed package)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []  # folders of this process' intermediate tables


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, removed by ``remove_written``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/donorlens-llm/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the intermediate tables and files that the operators have
    written so far; to be called when their results are stored elsewhere."""
    paths, _MADE[:] = list(_MADE), []
    for path in paths:
        system, where = file_system(spark, path)
        system.delete(where, True)
    return len(paths)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a Python worker builds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on


# --- word hashing over Arrow buffers -----------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _MULT, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def hash_words(data: np.ndarray, lower: bool = True, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of a byte array.

    Works through pieces of about ``piece`` bytes, cut at white space, so the
    working memory stays bounded for very long texts."""
    hashes, starts, ends = [], [], []
    at, size = 0, len(data)
    while at < size:
        stop = min(at + piece, size)
        if stop < size:
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            while not len(gaps) and stop < size:  # one word longer than the piece
                nxt = min(stop + piece, size)
                gaps = np.flatnonzero(_SPACE[data[stop:nxt]]) + (stop - at)
                stop = nxt
            if len(gaps) and stop < size:
                stop = at + int(gaps[-1]) + 1
        part = data[at:stop]
        full = ~_SPACE[part]
        edge = np.diff(np.concatenate(([0], full.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            length = e - s
            within = np.flatnonzero(full)
            first = np.cumsum(length) - length
            place = np.arange(len(within)) - np.repeat(first, length)
            chars = part[within]
            if lower:
                chars = _LOWER[chars]
            terms = _BYTE[chars] * _powers(int(length.max()))[place]
            hashes.append(mix64(np.add.reduceat(terms, first) + length.astype(np.uint64) * _MULT))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def text_bytes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, UTF-8 bytes) of every text of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1] if len(column) else []
    data = np.frombuffer(buffers[2], dtype=np.uint8) if len(column) and buffers[2] is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for row in range(len(column)):
        yield row, data[offsets[row]: offsets[row + 1]] if valid[row] else data[:0]

"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk_chars`` are encoded where they are read.  A longer text is
cut into overlapping chunks that are dealt over the cluster and pre-tokenised
side by side.  A pre-token boundary depends only on the text after the
previous boundary, so two neighbouring chunks agree from their first common
boundary on: that is where they are stitched.  Only boundaries between a
letter or digit and a space or line end are used: no pre-token can span them,
so encoding a piece alone gives the pre-tokens of the whole text.  Where an
overlap has no such common boundary the rest of that text stays one piece.
Decoding concatenates the raw bytes of the ids; ``round_trip`` does both in
the same tasks, so that ids need not pass through a second Python worker.

Defined results: null text counts as empty (no ids); null and repeated
``doc_id`` rows are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_LOADED: dict = {}


def load_ranks(path: str | None = None) -> bytes:
    """The rank file's content (under 1 MB, so it travels with the tasks)."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def _tables(ranks: bytes, pattern: str):
    """Encoder and id-to-bytes table, built once per Python worker."""
    key = hash((ranks, pattern))
    if key not in _LOADED:
        import tiktoken

        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        encoder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        raw = [b""] * (max(merges.values()) + 1)
        for token, rank in merges.items():
            raw[rank] = token
        _LOADED[key] = encoder, raw
    return _LOADED[key]


def encode_text(text: str, encoder) -> bytes:
    """Ids of one piece as little-endian unsigned 32-bit integers."""
    return np.asarray(encoder.encode_ordinary(text), dtype="<u4").tobytes()


def decode_ids(ids: bytes, raw: list[bytes]) -> bytes:
    return b"".join(map(raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def token_starts(text: str, pattern) -> list[int]:
    return [m.start() for m in pattern.finditer(text)]


def _with_ids(batch: pa.RecordBatch, names: list[str], ids: list[bytes], raw: list[bytes] | None) -> pa.RecordBatch:
    """Columns ``names`` of the batch, ``ids`` and, given the table, ``decoded``."""
    made = {"ids": ids} if raw is None else {"ids": ids, "decoded": [decode_ids(i, raw) for i in ids]}
    arrays = [*map(batch.column, names), *[pa.array(v, pa.binary()) for v in made.values()]]
    return pa.RecordBatch.from_arrays(arrays, [*names, *made])


def _encode_batches(ranks: bytes, pattern: str, decoded: bool = False) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, raw = _tables(ranks, pattern)
        for batch in small_batches(batches):
            ids = [encode_text(t or "", encoder) for t in batch.column("text").to_pylist()]
            yield _with_ids(batch, [n for n in batch.schema.names if n != "text"], ids, raw if decoded else None)

    return run


def _cut_batches(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for i in range(n):
                    part = text[i * chunk: (i + 1) * chunk + (overlap if i + 1 < n else 0)]
                    yield pa.RecordBatch.from_pydict({"k": [k], "i": pa.array([i], pa.int32()), "last": [i + 1 == n], "text": [part]})

    return run


def _boundary_batches(pattern: str, chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                starts = token_starts(text, split)
                heads.append([p for p in starts if p < overlap])
                tails.append([p - chunk for p in starts if p >= chunk and text[p] in " \n" and text[p - 1].isalnum()])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], [*batch.schema.names, "head", "tail"])

    return run


def _join_batches(ranks: bytes, pattern: str, decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _tables(ranks, pattern)[1] if decoded else None
        for batch in small_batches(batches, 16):  # long texts
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
            yield _with_ids(batch, ["doc_id", "copies"], ids, raw)

    return run


def _decode_batches(ranks: bytes, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, raw = _tables(ranks, pattern)
        for batch in small_batches(batches):
            out = [decode_ids(ids or b"", raw) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks: bytes | None = None, pattern: str = public_tokenizers.PATTERN,
           chunk_chars: int = 32768, overlap_chars: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id``, ``ids`` (binary, little-endian uint32)."""
    return _encoded(docs, ranks or load_ranks(), pattern, chunk_chars, overlap_chars, decoded=False)


def round_trip(docs: DataFrame, ranks: bytes | None = None, pattern: str = public_tokenizers.PATTERN,
               chunk_chars: int = 32768, overlap_chars: int = 1024) -> DataFrame:
    """The rows of ``encode`` and ``decoded``, the raw bytes that their ids stand for."""
    return _encoded(docs, ranks or load_ranks(), pattern, chunk_chars, overlap_chars, decoded=True)


def _encoded(docs: DataFrame, ranks: bytes, pattern: str, chunk_chars: int, overlap_chars: int, decoded: bool) -> DataFrame:
    made = ["ids", "decoded"] if decoded else ["ids"]
    made_types = "".join(f", {name} binary" for name in made)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = (rows.where(F.length("text") <= chunk_chars)
             .mapInArrow(_encode_batches(ranks, pattern, decoded), f"doc_id long{made_types}"))

    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")), 256)
    long = (rows.where(F.length("text") > chunk_chars)
            .groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("k", key))
    chunks = (long.select("k", "text")
              .mapInArrow(_cut_batches(chunk_chars, overlap_chars), "k string, i int, last boolean, text string")
              .repartition("k", "i")
              .mapInArrow(_boundary_batches(pattern, chunk_chars, overlap_chars),
                          "k string, i int, last boolean, text string, head array<int>, tail array<int>"))
    order = Window.partitionBy("k").orderBy("i")
    # the stitch with the next chunk: their first common boundary; once one is
    # missing, what follows is no longer known to be in step
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    stitched = (chunks.withColumn("cut", cut)
                .withColumn("begin", F.coalesce(F.lag("cut").over(order), F.lit(0)))
                .withColumn("lost", F.sum(F.when(F.col("cut").isNull() & ~F.col("last"), 1).otherwise(0)).over(order))
                .withColumn("lost_before", F.sum(F.when(F.col("cut").isNull() & ~F.col("last"), 1).otherwise(0))
                            .over(order.rowsBetween(Window.unboundedPreceding, -1))))
    first_lost = (F.col("lost") > 0) & (F.coalesce("lost_before", F.lit(0)) == 0)
    begin = F.when((F.col("lost") == 0) | first_lost, F.col("begin")).otherwise(0)
    end = F.when(F.col("lost") > 0, F.lit(chunk_chars)).when(F.col("last"), F.length("text")).otherwise(chunk_chars + F.col("cut"))
    cutout = stitched.select("k", "i", (F.col("lost") > 0).alias("open"), F.substring("text", begin + 1, end - begin).alias("text"))
    rest = (cutout.where("open").groupBy("k")
            .agg(F.min("i").alias("i"), F.array_sort(F.collect_list(F.struct("i", "text"))).alias("parts"))
            .select("k", "i", F.array_join(F.col("parts.text"), "").alias("text")))
    pieces = cutout.where(~F.col("open")).select("k", "i", "text").unionByName(rest)
    encoded = pieces.mapInArrow(_encode_batches(ranks, pattern), "k string, i int, ids binary")
    whole = (encoded.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
             .join(long.select("k", "doc_id", "copies"), "k")
             .select("doc_id", "copies", "parts")
             .mapInArrow(_join_batches(ranks, pattern, decoded), f"doc_id long, copies long{made_types}")
             .select("doc_id", *made, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy"))
    return short.unionByName(whole)


def decode(encoded: DataFrame, ranks: bytes | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded`` (raw bytes) to ``doc_id``, ``ids``."""
    return (encoded.select("doc_id", "ids")
            .mapInArrow(_decode_batches(ranks or load_ranks(), pattern), "doc_id long, ids binary, decoded binary"))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlens.llm import queries, resample
from tests.llm.conftest import ODD, SMALL

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
FEATURE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return FEATURE_WORDS.findall((text or "").translate(LOWER))


def brute(docs, target, percent=10, min_words=20, longest=1, buckets=10_000):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    gains = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gains[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k in range(len(rows)) if len(words(docs[k][1])) >= min_words), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(order[:percent * len(order) // 100])}
    return sorted(((*r, rank.get(k)) for k, r in enumerate(rows)), key=str)


def test_query_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = queries.op11_target_resampling(spark, SMALL).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target)
    assert got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}


@pytest.mark.parametrize("options", [{"percent": 100, "min_words": 0}, {"percent": 50, "min_words": 1, "longest": 3, "buckets": 97}])
def test_odd_rows(spark, docs_of, options):
    docs = [*ODD, (2**62, "big id one two"), (-2**62, "low id one two"), (5, "tied"), (5, "tied")]
    target = ["one two three", None, "", "word of the id"]
    got = resample.resample(docs_of(docs), spark.createDataFrame([(t,) for t in target], "text string"), block_rows=2, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, **options)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs_of([]), none).count() == 0
    docs = [(1, "one two " * 20), (2, "three " * 30)]
    assert sorted(map(tuple, resample.resample(docs_of(docs), none, percent=100).collect()), key=str) == brute(docs, [], percent=100)
    clash = spark.createDataFrame([(1, "one " * 20, 3, "x")], "doc_id long, text string, score long, place string")
    assert resample.resample(clash, none, percent=100).count() == 1


def test_radix_sort_of_ties_and_wide_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randint(-50, 50), rng.randint(-2**63, 2**63 - 1)]), rng.choice([7, -3, rng.randint(-10**12, 10**12)]), k) for k in range(900)]
    rows += [(1, 7, 900 + k) for k in range(400)]  # a hot key
    got = resample.radix_sorted(spark.createDataFrame(rows, "doc_id long, score long, seq long"), block_rows=16).collect()
    assert sorted(r.place for r in got) == list(range(len(rows)))
    want = sorted(((-s, i is None, i or 0) for i, s, _ in rows))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.place)] == want


def test_blocks_bound_the_tasks(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(2).cast("long").alias("score"), F.col("id").alias("seq"))
    placed = resample.radix_sorted(rows, block_rows=100)
    assert placed.groupBy(F.expr("place div 100")).count().where("count > 100").count() == 0


def test_checksums_of_pieces(monkeypatch):
    text = "Ünï Abc 123 " + "long" * 40 + " x " * 30
    want = [zlib.crc32(w.encode()) % 1000 for w in words(text)]
    data = np.frombuffer(text.encode(), np.uint8)
    for piece in (1 << 20, 16):
        monkeypatch.setattr(resample, "PIECE", piece)
        for longest in (1, 3):
            found = list(resample.feature_buckets(data, longest, 1000))
            assert sum(n for n, _ in found) == len(want)
            got = sorted(np.concatenate([f for _, f in found]).tolist())
            w = words(text)
            assert got == sorted(zlib.crc32(" ".join(w[i:i + n]).encode()) % 1000 for n in range(1, longest + 1) for i in range(len(w) - n + 1))

"""Flat token files against the tokenizers library."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from donorlens.llm import flat_ids, queries
from tests.llm.conftest import ODD, SMALL

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(flat_ids.VOCABULARY))


def brute(library, rows):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order, nulls first."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def encoded(encoder, texts):
    out = [b""] * len(texts)
    for row, ids in encoder.encoded(texts):
        out[row] += ids
    return [np.frombuffer(ids, encoder.kind).tolist() for ids in out]


def test_words_alone_give_the_texts_ids(library):
    texts = [t for _, t in ODD] + [
        "Don't we'll THEY'RE 'S 'tis", "a\x1cb\x85c\xa0d\u2003e", "H\u0331 I\u0307 Ⅷ ǅ ß ẞ İ ΑΣ", "<|endoftext|> x <|ENDOFTEXT|>", "x<|startoftext|>y!!'s 12ab34",
        "\u0301start e\u0301 \u0301", "À\u0301B É\u0302x ÀÖØÞßàöøþÿ×÷ªºµ²½ é1è2", "tab\tnl\nvt\x0bff\x0ccr\rzero\x00del\x7f", "汉字 仮名 한국어 🙂🙂", "##%% ''ll 'd'd'", "A" * 3000]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(flat_ids.WordEncoder(library.to_str()), texts) == want


def test_long_texts_and_forgotten_words(library, monkeypatch):
    monkeypatch.setattr(flat_ids, "PIECE", 50)
    monkeypatch.setattr(flat_ids, "REMEMBERED", 5)
    texts = ["one two, three! " * 40, "Ünï çødé " * 40, "x" * 300, None, "x" * 300 + " y", "", "one two"]
    assert encoded(flat_ids.WordEncoder(library.to_str()), texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_vocabularies_without_word_ends(library):
    encoder = flat_ids.WordEncoder(library.to_str())
    encoder.ends_word[:] = False
    assert encoded(encoder, ["one two's three-four", "Ünï"]) == [library.encode(t, add_special_tokens=False).ids for t in ("one two's three-four", "Ünï")]


def test_query_rows(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_flat_token_ids(spark, SMALL).collect())) == brute(library, rows)


def test_files_hold_every_row_in_order(spark, docs_of, library):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several files from a small table
    try:
        rows = ODD + [(k % 7, f"text {k} of many") for k in range(300)]
        folder = flat_ids.write(docs_of(rows).repartition(5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    table = flat_ids.files(spark, folder).orderBy("file_no").collect()
    assert len(table) > 3 and sum(f.n_docs for f in table) == len(rows)
    got = flat_ids.read(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = brute(library, rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), n, c) for i, _, n, c in want)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    flat = flat_ids.FlatIds(folder)
    assert len(flat) == len(whole) and (flat.ids(0, len(whole)) == whole).all() and (flat.ids(700, 90_000) == whole[700:90_000]).all()
    for k in (0, 1, 150, len(got) - 1):
        doc_id, ids = flat.document(k)
        assert doc_id == got[k].doc_id and ids.tobytes() == bytes(got[k].ids)


def test_empty_tables_and_other_columns(spark, docs_of, library):
    folder = flat_ids.write(docs_of([]))
    assert flat_ids.read(spark, folder).count() == 0 and len(flat_ids.FlatIds(folder)) == 0
    clash = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, hash string, row long, start long")
    assert [tuple(r) for r in flat_ids.read(spark, flat_ids.write(clash)).collect()] == brute(library, [(1, "a b")])


def test_remote_folders_are_refused():
    with pytest.raises(ValueError):
        flat_ids.local_path("s3a://bucket/ids")
    assert flat_ids.local_path("file:///a/b") == "/a/b" == flat_ids.local_path("/a/b")

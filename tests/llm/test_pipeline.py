"""The pipeline's stages, one by one, against brute-force decisions on their own input."""

from collections import Counter

import corpus_pipeline
from donorlens.llm import bpe
from tests.llm.conftest import ODD, SMALL
from tests.llm.test_operators import brute_components, brute_lines, words


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    given = None
    for name, stage in corpus_pipeline.STAGES:
        before = given or [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        if name == "byte_bpe":
            encoder, _ = bpe._tables(bpe.load_ranks(), bpe.public_tokenizers.PATTERN)
            assert Counter((r.doc_id, r.n_tokens) for r in docs.collect()) == Counter((i, len(encoder.encode_ordinary(t))) for i, t in before)
            continue
        assert docs.columns == names
        given = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality":
            assert 0.7 * len(before) < len(given) < len(before)
        elif name == "line_dedup":
            assert sorted(given) == sorted((i, t) for i, t, n in brute_lines(before) if not n or words(t))
        elif name == "near_duplicates":
            assert {i for i, _ in given} == {i for i, (_, c) in brute_components(before).items() if i == c} and len(given) == len({i for i, _ in given})
        elif name == "source_mixing":
            assert set(given) == set(before) and max(Counter(given).values()) <= 2


def test_odd_rows_pass(spark, docs_of):
    docs = docs_of([(*r, "en", "s" if k % 2 else None, 1) for k, r in enumerate(ODD)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0

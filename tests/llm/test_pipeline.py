"""The pipeline against its stages said plainly."""

import hashlib

import pytest

import corpus_pipeline
from tidemark.llm.common import written

from .test_pairs import brute_classes


def test_stages_equal_brute_force(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    items = [b.text for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    last = {d.text: d for d in docs}  # of equal texts the largest id
    docs = sorted(last.values(), key=lambda d: d.doc_id)
    heads = brute_classes([d.text for d in docs])
    docs = [d for i, d in enumerate(docs) if heads[i] == i]
    plain = lambda t: " ".join(t.lower().split())
    docs = [d for d in docs if not any(plain(b) in plain(d.text) for b in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {(d.doc_id, hashlib.sha256(",".join(map(str, sp.encode(d.text))).encode()).hexdigest()) for d in docs}
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_takes_odd_rows(stage, spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "the and of with that this from", "en", "s", 3), (4, "the and of with that this from", "en", "s", 3), (4, "word " * 60_000, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = written(spark.createDataFrame(rows, schema), "docs")
    name, function = corpus_pipeline.STAGES[stage]
    for some in (docs, written(docs.limit(0), "docs")):
        out = function(spark, some, sf_dir)
        n = out.count()
        assert n <= some.count()
        if stage < 4:
            assert out.columns == docs.columns

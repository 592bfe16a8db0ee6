"""The pipeline's stages against brute force, one after the other."""

import collections
import hashlib
import re

import numpy as np
import pytest
from test_operators import SF, brute_components, brute_contaminated

import corpus_pipeline
from aforo.llm import toxicity


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def extended(spark, raw):
    """The documents with repeated rows, nulls and a column whose name operators use themselves."""
    more = spark.createDataFrame([(70_001, None, "en", "src0", 0), (70_002, "", "en", "src0", 0), (70_003, "same  text here", "en", "src0", 15), (70_003, "same  text here", "en", "src0", 15), (None, "same text here", "en", "src0", 14)], raw.schema)
    return raw.unionByName(more).withColumn("row", corpus_pipeline.decontaminate.F.lit("mine"))


def test_toxicity_stage(spark, raw):
    docs = extended(spark, raw)
    kept = stage("toxicity")(spark, docs, SF)
    score = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")).scorer()
    assert kept.columns == docs.columns
    assert rows(kept) == collections.Counter((r.doc_id, r.text) for r in docs.collect() if score([(r.text or "").encode()])[0] < toxicity.THRESHOLD)


def test_exact_stage(spark, raw):
    docs = extended(spark, raw)
    kept = stage("exact dedup")(spark, docs, SF)
    first = {}
    for r in docs.collect():
        key, order = re.sub(r"[ \t\n\v\f\r]+", " ", r.text or ""), (r.doc_id is None, r.doc_id)
        if key not in first or order < first[key][0]:
            first[key] = order, (r.doc_id, r.text)
    assert kept.columns == docs.columns and rows(kept) == collections.Counter(v for _, v in first.values())


def test_near_and_later_stages(spark, raw):
    docs = stage("exact dedup")(spark, extended(spark, raw), SF)
    kept = stage("MinHash near-dedup")(spark, docs, SF)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    named = {d: c for d, (_, c) in brute_components([x for x in plain if x[0] is not None], 5).items()}
    assert kept.columns == docs.columns and rows(kept) == collections.Counter((d, t) for d, t in plain if d is None or named[d] == d)
    clean = stage("benchmark decontamination")(spark, kept, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contaminated([(r.doc_id, r.text) for r in kept.collect()], items)}
    assert clean.columns == docs.columns and rows(clean) == collections.Counter((r.doc_id, r.text) for r in kept.collect() if r.doc_id not in bad)


def test_run(spark, raw):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in raw.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) < len(texts) and len({r.doc_id for r in got}) == len(got)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]


def test_stages_on_an_empty_table(spark, raw):
    none = raw.limit(0)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = stage(name)(spark, none, SF)
        assert out.columns == raw.columns and out.count() == 0
    out = stage("SentencePiece encoding")(spark, none, SF)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_encoding_stage_keeps_every_row(spark, raw):
    docs = extended(spark, raw)
    out = stage("SentencePiece encoding")(spark, docs, SF)
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r.doc_id for r in docs.collect())
    assert {r.n_tokens for r in out.filter("doc_id IN (70001, 70002)").collect()} == {2}

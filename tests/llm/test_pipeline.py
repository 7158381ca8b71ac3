"""The pipeline against a plain version, held-out accuracy, and the registered queries."""

from __future__ import annotations

from zlib import crc32

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factloom.llm import langid, quality
from factloom.llm.common import table
from factloom.llm.wordbpe import public_vocabulary
from tests.llm import brute
from tests.llm.test_documents import bag, check_sequences
from tests.llm.test_shingles import jaccard_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline_against_a_plain_version(spark):
    docs = table(spark, SF, "documents").collect()
    # The learned model and the cutoffs are the operators' own; what follows from them is worked out here.
    vocabulary = public_vocabulary("piece_bpe_32k.model")
    told = langid.identify(table(spark, SF, "documents").select("doc_id", "text"), langid.train(table(spark, SF, "documents"), vocabulary), vocabulary)
    speaks = {r.doc_id for r in told.collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    first = [d for d in docs if d.doc_id in speaks]
    measured = quality.measure(table(spark, SF, "documents").where(F.col("doc_id").isin(list(speaks))))
    cuts = quality.verdicts(measured, quality.cutoffs(measured, table(spark, SF, "labels")))
    rejected = {r.doc_id for r in cuts.collect() if not r.kept and not r.base_failed}
    second = [d for d in first if not brute.quality_row(d.text)[-1] and d.doc_id not in rejected]
    # Near-duplicates: 5-word shingles with a Jaccard similarity of 0.8 or more.
    first_of = {k for k, low in jaccard_rows([(d.doc_id, d.text) for d in second]) if k == low}
    third = [d for d in second if d.doc_id in first_of]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = [(d.doc_id, *p) for d in third for p in brute.piece_rows(tokenizer, d.text)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == bag(want)
    check_sequences(got, 2048)
    assert 0 < len(third) < len(docs)


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "words without an id " * 5, "en", "s", 5), (2, "", "en", "s", 0), (3, "some plain words stand here and there in this text now", "en", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        # Only the plain sentence is long enough and no copy; of its two rows one stays.
        assert [r.doc_id for r in out] == ([3] if frame is docs else [])


def test_held_out_language_accuracy(spark):
    docs, vocabulary = table(spark, "/root/testdata/sf0.01", "documents"), public_vocabulary("piece_bpe_32k.model")
    told = langid.identify(docs.select("doc_id", "text", "lang"), langid.train(docs, vocabulary), vocabulary).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert all(crc32(str(r.doc_id).encode()) % 5 == 0 for r in told)
    right = sum(r.lang == r.lang_pred for r in told) / len(told)
    assert len(told) > 50 and right > 0.97


def test_registered_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Operators on documents against plain versions, over nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, langid, licenses, ngrams, packing, quality, simhash, wordbpe
from tests.llm import brute

BPE, PIECES = wordbpe.public_vocabulary("word_bpe_49k.json"), wordbpe.public_vocabulary("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 700} über{i % 11}." for i in range(9000))
PARAGRAPH = "The heating in the old house was repaired by a contractor who came from the next town on Monday morning. "
ROWS = [
    (1, None, "en"), (2, "", "de"), (3, "Word", "en"), (4, " \n\t \x0b", None), (5, LONG, "en"), (6, LONG, "de"), (6, LONG, "de"),
    (7, PARAGRAPH * 9, "en"), (8, PARAGRAPH * 9 + "Tail end.", None), (None, "without an id at all", "en"), (9, "Zażółć gęślą jaźń 東京 <|endoftext|> ÉTÉ İstanbul ß", "pl"),
    (10, "a\na\na\nb # * $ | < >", "en"), (11, "MIT License. Licensed under the Apache License, Version 2.0; GNU General Public License v3", "en"),
    (12, "SPDX-License-Identifier: MIT\nhttps://opensource.org/licenses/MIT mit license", None), (13, "12345 ... !!!", "en"), (14, "x" * 50_000, "en"),
    (15, "one two three four five six seven eight nine ten", "en"), (16, "   nbsp 　x", "de"),
]
NAMES = ["n_words", "kept", "label", "score", "_text", "code", "component_id", "row", "lang_pred", "stratum", "piece", "offset"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return plain.select("*", *[F.lit("mine").alias(n) for n in NAMES]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(BPE)
    made.no_truncation()
    made.no_padding()
    return made


def bag(rows):
    return sorted(map(repr, rows))


def test_licenses(docs, empty):
    found = licenses.scan(docs.select("doc_id", "text")).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in found]
    assert bag(got) == bag([(k, *brute.license_row(t)) for k, t, _ in ROWS])
    assert licenses.scan(docs).count() == len(ROWS)
    assert licenses.scan(empty).count() == 0
    assert len(licenses.rules()) > 200


def test_license_containment(spark):
    text = "released under the terms of the GNU Lesser General Public License, version 2.1"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # The longer name hides the plain one; the base label stays.
    assert row.labels == "gpl,lgpl-2.1" and row.base_labels == "gpl" and row.score == 0.9


def test_quality_measures(docs, empty):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.measure(docs).collect()]
    assert bag(got) == bag([(k, *brute.quality_row(t)) for k, t, _ in ROWS])
    assert quality.measure(empty).count() == 0


def test_quality_without_labels_rejects_by_the_base_only(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = [(r.doc_id, r.kept) for r in quality.judge(docs, labels).collect()]
    assert bag(got) == bag([(k, not brute.quality_row(t)[-1]) for k, t, _ in ROWS])


def test_quality_ignores_null_labels_and_counts_the_lowest(spark, docs):
    labels = spark.createDataFrame([(15, 1), (15, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.judge(docs, labels).count() == len(ROWS)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.002), (0, 3000, 0.002), (3, 5000, 0.002), (17, 20_000, 0.002), (0, 1, 0.002)])
def test_binomial_tail(spark, k, n, p):
    value = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    assert value == pytest.approx(brute.binomial_tail(k, n, p), rel=1e-9)


def test_cutoffs_hold_the_risk(spark):
    # 20000 good rows: a cutoff passes only if it rejects far fewer than the risk allows.
    base = {m: F.lit(-100.0) for m in quality.CUTOFFS}
    rows = spark.range(20_000).select(F.lit("en").alias("stratum"), F.lit(True).alias("good"), *[c.alias(m) for m, c in base.items() if m != "symbol_share"], (F.col("id") / 20_000 * 0.1).alias("symbol_share"))
    cut = quality.select_cutoffs(rows).first()["cut_symbol_share"]
    # 0.1 rejects none, 0.08 a fifth.
    assert cut == 0.1


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs, words=3, bits=2).collect()
    codes = [(k, brute.fingerprint(t)) for k, t, _ in ROWS]
    low = brute.groups({c for _, c in codes}, lambda a, b: (a ^ b).bit_count() <= 2)
    first = defaultdict(lambda: 10**9)
    for k, c in codes:
        if k is not None:
            first[low[c]] = min(first[low[c]], k)
    name = lambda c: None if first[low[c]] == 10**9 else first[low[c]]
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == bag((k, f"{c:016x}", name(c)) for k, c in codes)
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_index_finds_all_links():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))]
    codes = np.unique(np.array([*base, *flips], dtype=np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    who, leaf = simhash.GrayIndex(codes).search(codes, 2)
    want = {(i, j) for i, a in enumerate(codes.tolist()) for j, b in enumerate(codes.tolist()) if (a ^ b).bit_count() <= 2}
    assert set(zip(who.tolist(), leaf.tolist(), strict=True)) == want


def test_bpe_against_the_library(docs, empty, tokenizer):
    got = [tuple(r) for r in bpe.encode_documents(docs, BPE).collect()]
    assert bag(got) == bag([(k, *brute.bpe_row(tokenizer, t)) for k, t, _ in ROWS])
    assert bpe.encode_documents(empty, BPE).count() == 0


def test_chunks_are_cut_by_content():
    gears = bpe.gear()
    a, b = LONG.encode(), ("other text in front " + LONG).encode()
    cut = lambda raw: [raw[x:y] for x, y in zip(bpe.cuts(raw, gears), bpe.cuts(raw, gears)[1:])]
    assert b"".join(cut(a)) == a
    assert len(set(cut(a)) & set(cut(b))) > len(cut(a)) / 2


def test_pieces_and_packing(docs, empty, tokenizer):
    rows = packing.pack_documents(docs, BPE).collect()
    want = [(k, *p) for k, t, _ in ROWS for p in brute.piece_rows(tokenizer, t)]
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == bag(want)
    check_sequences(rows, 2048)
    assert packing.pack_documents(empty, BPE).count() == 0


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_tight(spark, monkeypatch):
    cut = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    monkeypatch.setattr(packing, "TASK_PIECES", 1000)
    rows = packing.pack(cut, 2048).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(rows) == 5000 and check_sequences(rows, 2048) <= least + 2


def test_stupid_backoff(docs, empty):
    got = ngrams.score(docs).collect()
    texts = {i: t for i, (_, t, _) in enumerate(ROWS)}
    want = brute.backoff_rows(texts, ngrams.LEAST_COUNT, ngrams.BACKOFF)
    shown = lambda k, n, s, m: (k, n, round(s, 4), None if m is None else round(m, 6))
    assert bag(shown(r.doc_id, r.n_words, r.log_score, r.score) for r in got) == bag(shown(ROWS[i][0], *w) for i, w in want.items())
    assert ngrams.score(empty).count() == 0


def test_language_sums_all_segmentations(docs, empty):
    model = langid.train(docs, PIECES)
    got = langid.identify(docs.select("doc_id", "text", "label"), model, PIECES).collect()
    from sentencepiece import SentencePieceProcessor

    have, names = langid.pieces(PIECES), {}
    model_file = SentencePieceProcessor(model_file=PIECES)
    every = range(model_file.get_piece_size())
    kept = sorted({model_file.id_to_piece(i) for i in every if not (model_file.is_control(i) or model_file.is_unknown(i) or model_file.is_byte(i) or model_file.is_unused(i)) and len(model_file.id_to_piece(i)) <= langid.LONGEST})
    names = {x: i for i, x in enumerate(kept)}
    short = [(k, t) for k, t, _ in ROWS if len(t or "") < 2000]
    want = {(k, *brute.language(t, model, names, have.unknown)) for k, t in short}
    told = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got if len(r.text or "") < 2000}
    assert told == {(k, p, round(s, 6)) for k, p, s in want}
    assert {r.label for r in got} == {"mine"}
    assert langid.identify(empty, model, PIECES).count() == 0


def test_nothing_learned_gives_und(docs, empty):
    model = langid.train(empty, PIECES)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.select("doc_id", "text"), model, PIECES).collect()} == {("und", 0.0)}

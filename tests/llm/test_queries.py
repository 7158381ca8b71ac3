"""Every registered query over the whole smallest tables, against its SQL or a plain version."""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import duckdb
import pytest

import __spark_entry__
from factloom.llm import licenses
from factloom.llm.common import table
from factloom.llm.wordbpe import public_vocabulary
from tests.llm import brute
from tests.llm.test_documents import bag, check_sequences
from tests.test_catalog import TABLES
from tests.test_catalog import bag as sql_bag

SF = "/root/testdata/sf0.001"
QUERIES = {n.split("_")[0]: f for n, f in __spark_entry__.queries().items() if n.startswith("op")}
SQL = {n.split("_")[0]: q for n, q in __spark_entry__.oracle_sql().items() if n.startswith("op")}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    made.no_truncation()
    made.no_padding()
    return made


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, SF), con.execute(SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got = sql_bag(found.columns, found.collect())
    assert got and got == sql_bag(names, wanted.fetchall())


def test_every_outcome_of_a_revisit_is_met(spark):
    rows = QUERIES["op5"](spark, "/root/testdata/sf0.01").select("outcome", "url_key", "record_id", "resolved_id").collect()
    assert {r.outcome for r in rows} == {"resolved", "mismatch", "unvalidated", "no_response"}
    assert any(r.resolved_id is not None and r.url_key == "hot.example/" for r in rows) and any(r.resolved_id is not None and r.url_key != "hot.example/" for r in rows)


def test_op1(spark):
    vectors = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    got = QUERIES["op1"](spark, SF).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute.embedding_rows(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    # What the last audit measured: nothing where the audited nodes have no link.
    assert len({(r.recall, r.audited_links) for r in got}) == 1 and (got[0].recall, got[0].audited_links) in {(None, 0), (1.0, got[0].audited_links)}


def test_op6(spark, documents):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in QUERIES["op6"](spark, SF).collect()]
    assert bag(got) == bag([(k, *brute.license_row(t)) for k, t in documents]) and len(licenses.rules()) > 200


def test_op7(spark, documents):
    codes = [(k, brute.fingerprint(t)) for k, t in documents]
    low, first = brute.groups({c for _, c in codes}, lambda a, b: (a ^ b).bit_count() <= 2), defaultdict(lambda: 10**12)
    for k, c in codes:
        first[low[c]] = min(first[low[c]], k)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op7"](spark, SF).collect()]
    assert bag(got) == bag((k, f"{c:016x}", first[low[c]]) for k, c in codes)


def test_op8(spark, documents, tokenizer):
    assert bag(tuple(r) for r in QUERIES["op8"](spark, SF).collect()) == bag((k, *brute.bpe_row(tokenizer, t)) for k, t in documents)


def test_op9(spark, documents):
    rows = QUERIES["op9"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(k for k, _ in documents)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    letters = {k: any(c.isalpha() for c in t or "") for k, t in documents}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in rows)


def test_op10(spark, documents, tokenizer):
    rows = QUERIES["op10"](spark, SF).collect()
    want = [(k, *p) for k, t in documents for p in brute.piece_rows(tokenizer, t)]
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == bag(want)
    assert check_sequences(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_a_long_run_of_letters_is_summed_whole(spark):
    from factloom.llm import langid

    vocabulary = public_vocabulary("piece_bpe_32k.model")
    rows = [(i, w * n, lang) for i, (w, n, lang) in enumerate([("haus", 50, "de"), ("casa", 50, "es"), ("haus", 3, "de"), ("casa", 3, "es"), ("hauscasa", 5, "de"), ("", 1, "es")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, vocabulary)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.select("doc_id", "text"), model, vocabulary).collect()}
    from sentencepiece import SentencePieceProcessor

    file = SentencePieceProcessor(model_file=vocabulary)
    every = range(file.get_piece_size())
    kept = sorted({file.id_to_piece(i) for i in every if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i)) and len(file.id_to_piece(i)) <= langid.LONGEST})
    for key, text, _ in rows:
        pred, score = brute.language(text, model, {x: i for i, x in enumerate(kept)}, len(kept))
        assert told[key][0] == pred and told[key][1] == pytest.approx(score, abs=1e-9)

"""Attention over passages: gradients, a toy where one passage decides, odd rows, held-out rows, whole tables."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factloom.llm import attention
from factloom.llm.common import table

SF = "/root/testdata/sf0.01"
GOOD, BAD = "the quiet river runs along green fields and small old towns ", "@@ ## $$ %% !! "


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    model = attention.Model.fresh(3)
    x, starts, y = r.normal(size=(9, attention.INPUTS)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.weighed(x, starts)[5]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(x, starts, y)
    for name, d in found.items():
        flat = model.weights[name].reshape(-1)
        for i in r.integers(0, flat.size, 5):
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert d.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_one_passage_decides_and_has_the_weight():
    r, bags, labels = np.random.default_rng(5), [], []
    for i in range(300):
        parts = [GOOD * 6] * r.integers(3, 9)
        if i % 2:
            parts[r.integers(0, len(parts))] = BAD * 13
        bags.append(attention.passages(" ".join(parts).encode()))
        labels.append(1 - i % 2)
    model = attention.fitted(bags, labels)
    text = " ".join([" ".join((GOOD * 6).split()[:64])] * 5 + [" ".join((BAD * 13).split()[:64])] + [" ".join((GOOD * 6).split()[:64])] * 4)
    score, weights = model.score(text.encode())
    assert score < 0.3 and int(np.argmax(weights)) == 5 and sum(weights) == pytest.approx(1) and len(weights) == 10
    assert model.score((GOOD * 60).encode())[0] > 0.9


def test_scores_of_blocks_equal_the_whole(monkeypatch):
    model, text = attention.Model.fresh(2), ((GOOD + BAD) * 300).encode()
    h, t, g, a, z, p, _ = model.weighed(attention.passages(text), np.array([0]))
    monkeypatch.setattr(attention, "BLOCK", 3)
    score, weights = model.score(text)
    assert score == pytest.approx(p[0]) and weights == pytest.approx(a.tolist())


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t", 5), (4, "x" * 100_000, 5), (5, GOOD * 3000, 5), (5, GOOD * 3000, 5), (None, "é 東京 \x00", 5), (6, BAD, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long").withColumns({"predicted": F.lit("x"), "y": F.lit("x"), "size": F.lit("x"), "model": F.lit("x")})
    labels = spark.createDataFrame([(5, 1, "t"), (6, 0, "t"), (5, 1, "t"), (1, None, "t"), (2, 0, "t"), (2, 1, "t"), (None, 0, "t"), (77, 1, "t")], "doc_id long, quality int, text string")
    model = attention.train(docs, labels)
    got = attention.score(docs, model)
    assert sorted(got.columns) == sorted(["doc_id", "text", "y", "size", "model", "score", "predicted", "n_passages", "top_passage"])
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    by = {r.doc_id: r for r in found}
    assert by[1].score == by[2].score == by[3].score and by[5].n_passages == -(-3000 * 11 // 64) and by[4].n_passages == 1
    assert attention.score(docs.limit(0), model).count() == 0
    untaught = attention.train(docs.limit(0), labels)
    assert all(0 <= r.score <= 1 for r in attention.score(docs, untaught).collect())


def test_held_out_rows_teach_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = attention.held_out(F.col("doc_id"))
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = attention.train(docs, labels), attention.train(docs, other)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_held_out_rows_are_told_apart(spark):
    rows = __spark_entry__.queries()["op11_attention_quality"](spark, SF).collect()
    ids = [r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.95 * len(held)

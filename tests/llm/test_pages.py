"""Embeddings, URLs and archive captures against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import neardup, urlfilter, warc
from factloom.llm.common import components
from factloom.llm.queries import URL_RULES
from tests.llm import brute


def vectors():
    rng = random.Random(3)
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [float("nan"), 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1), (7, [1.0, 2.0, 3.0], None), (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [-0.0, 1.0], 1), (11, [0.0, 1.0], 1)]
    key = 20
    for label in (1, 2):
        for _ in range(12):
            centre = [rng.gauss(0, 1) for _ in range(8)]
            for _ in range(rng.choice([1, 1, 2, 9])):
                rows.append((key, [x + rng.gauss(0, 0.06) for x in centre], label))
                key += 1
                if rng.random() < 0.2:
                    rows.append((key, rows[-1][1], label))
                    key += 1
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embedding_links(spark, kind):
    import numpy as np

    rows = vectors()
    if kind == "float":
        rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"id": F.lit("x"), "key": F.lit("y"), "vec": F.lit(1)}).repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(table, 0.98).collect())
    assert got == brute.embedding_rows(rows)


def test_embedding_empty_and_null_ids(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert neardup.near_duplicates(spark.createDataFrame([], shape)).count() == 0
    rows = neardup.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1), (5, [2.0], 1)], shape)).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in rows if r.vec_id) == [(4, 1), (5, 1)]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and {got[i] for i in range(101, 160)} == {100}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


PAGES = [
    (1, "http://A.Example.com/en/7?x=1#f", '<link rel="canonical" href="http://www.example.net/de/8">'),
    (2, "https://www.example.net/de/8", None),
    (3, "http://other.info/a", '<meta http-equiv="refresh" content="0; url=/b">'),
    (4, "http://other.info/b", '<LINK href="http://shop.com/en/1" REL="canonical">'),
    (5, None, '<link rel="canonical" href="http://shop.com/en/1">'),
    (6, "no scheme", "<html>"), (7, "http://", ""), (7, "http://", ""),
    (8, "http://free.info/x", '<link rel="canonical" href="http://example.com/en/7">'),
    (9, "http://free.info/y", '<link rel="canonical" href="http://free.info/x">'), (10, "ftp://x.org/es/?q", "x"), (None, "http://sub.x.org/esx", "x"),
    (11, "http://Notexample.com/en/7", "x"), (12, "http://both.info/1", '<link rel=canonical href="http://example.com/en/7"><link rel=canonical href="http://example.net/de/8">'),
]


def test_url_filter(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "rule": F.lit("r"), "node": F.lit("n")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(table, URL_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("www.example.net", "/de/8", "example.net/de/8", "block")
    # An alias of an alias of a blocked page.
    assert got[3] == ("other.info", "/a", None, "block") and got[4][3] == "block"
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][3] == "allow" and got[9][3] == "allow"
    assert got[10] == ("x.org", "/es/", "org/es/", "block") and got[None] == ("sub.x.org", "/esx", None, "allow")
    assert got[11] == ("notexample.com", "/en/7", "com/en/", "block")
    # One of its aliases is explicitly allowed: that goes first.
    assert got[12][3] == "allow"
    assert urlfilter.judge(table.limit(0), URL_RULES).count() == 0


def test_many_rules_go_by_host(spark, monkeypatch):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    few = sorted(map(repr, urlfilter.judge(table, URL_RULES).collect()))
    monkeypatch.setattr(urlfilter, "INLINE_RULES", 0)
    assert sorted(map(repr, urlfilter.judge(table, URL_RULES).collect())) == few


CAPTURE = "record_id long, url_key string, date long, kind string, status int, headers map<string,string>, digest string, range string"


def capture(record, url, date, kind="response", status=200, headers=None, digest=None):
    return (record, url, date, kind, status, headers, digest, "mine")


def test_revisits(spark):
    rows = [
        capture(1, "a", 10, headers={"ETag": '"1"', "Content-Type": "text/html", "Date": "d1"}),
        capture(2, "a", 10, headers={"ETag": '"2"', "Content-Type": "text/html", "Date": "d2"}),
        capture(3, "a", 20, "revisit", 304, {"etag": 'W/"2"', "DATE": "d3", "content-type": "text/plain"}),
        capture(4, "a", 10, "revisit", 304, {"etag": '"2"'}), capture(5, "a", 20, "revisit", 304, {"etag": '"x"'}), capture(6, "a", 20, "revisit", 304, None),
        capture(7, "b", 5, status=500), capture(8, "b", 9, "revisit", 304, {}), capture(9, None, 9, "revisit", 304, {}), capture(10, "a", None, "revisit", 304, {"etag": '"2"'}),
        capture(11, "c", 1, digest="s"), capture(12, "c", 2, "revisit", 304, {}, "s"), capture(12, "c", 2, "revisit", 304, {}, "s"), capture(13, "c", 2, "revisit", 304, {}, "t"), capture(14, "c", 3, "request"),
    ]
    table = spark.createDataFrame(rows, CAPTURE)
    got = {r.record_id: r for r in warc.resolve(table).collect()}
    assert {k: (r.resolved_id, r.outcome) for k, r in got.items()} == {
        3: (2, "resolved"), 4: (None, "no_response"), 5: (None, "mismatch"), 6: (None, "unvalidated"), 8: (None, "no_response"), 9: (None, "no_response"),
        10: (None, "no_response"), 12: (11, "resolved"), 13: (None, "mismatch"),
    }
    assert got[3].headers == {"etag": 'W/"2"', "content-type": "text/html", "date": "d3"}
    assert warc.resolve(table).count() == 10 and warc.resolve(table.limit(0)).count() == 0


def test_revisits_of_one_hot_url(spark):
    rng = random.Random(1)
    rows = [capture(i, rng.choice(["hot", "hot", "hot", "cold"]), rng.randrange(300), rng.choice(["response", "revisit"]), 200, {"etag": "same"}) for i in range(600)]
    got = {r.record_id: r.resolved_id for r in warc.resolve(spark.createDataFrame(rows, CAPTURE)).collect()}
    names = ["record_id", "url_key", "date", "kind", "status"]
    assert got == brute.revisit_rows([dict(zip(names, r, strict=False)) for r in rows])

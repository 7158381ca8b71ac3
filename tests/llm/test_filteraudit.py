"""The filter audit against a document-by-document application of every order."""

from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from factloom.llm import filteraudit
from tests.llm import brute

PLAIN = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, PLAIN, "en"), (2, PLAIN, "en"), (2, PLAIN, "en"), (3, None, None), (4, "", "de"), (5, "A # " * 200, "en"), (6, PLAIN + " $", None), (None, PLAIN, "en"), (0, "x\x0by\tz q", "de"),
    (7, PLAIN.upper(), "en"), (8, PLAIN * 2000, "en"), (9, "", "de"), (10, "ÄÖÜ" * 9 + "AB", "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]


def plain(rows, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    first: dict = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    fails = []
    for k, t, lang in rows:
        t, w = t or "", brute.words(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and k > first[t]}
        fails.append((k, lang or "", {f for f, x in bad.items() if x}))
    out = {}
    for part in {p for _, p, _ in fails}:
        own, total = [(k, f) for k, p, f in fails if p == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                before = len([1 for x in own if name in x[1]]) - len(gone)
                left = [x for x in left if name not in x[1]]
                total[name] += len(gone)
                out[part, order, step] = [len(left), len(gone), before, sum(x[1] == {name} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                out[part, order, step].append(total[name])
    return out


def test_audit_equals_plain_application(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({n: F.lit(1) for n in ("mask", "n", "good", "digest", "first", "part")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filteraudit.audit(docs.repartition(3), labels).collect()}
    assert got == plain(ROWS, LABELS)
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    assert filteraudit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("count", [1, 127, 128, 255, 2**31, 2**62])
def test_fields_never_overflow(count):
    rows = filteraudit.steps_of([(31, True, False, count), (0, False, True, count), (16, True, True, 1)])
    by = {(o, s): r for o, s, *r in rows}
    assert by["ABCDE", 1] == [count + 1, count, 0, 0, count, 0, 24 * count] and by["EABCD", 1][1] == count + 1
    assert by["ABCDE", 5] == [count, 1, count, 1, 1, 1, 24 * count + 120]
    assert len(rows) == 600

"""Tables of versions: rows replaced by key, dropped, added, compacted, and left alone when a run didn't end."""

from __future__ import annotations

import random

from factloom.sources import versions

SCHEMA = "k string, n int"


def table(spark, folder, token="a", complete=()):
    return versions.Versions(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, ["k"], token, complete)


def rows(df):
    return sorted((r.k or "", r.n) for r in df.collect())


def test_rows_are_replaced_dropped_and_added(spark, tmp_path):
    t = table(spark, tmp_path)
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.read().count() == 0
    base = [(f"x{i}", i) for i in range(40)]
    first = t.put(make(*base, (None, 7)), make(("never", 0)))
    assert (first.written, first.replaced) == (41, 0)
    put = t.put(make(("x1", 100), ("x1", 101)), make(("x1", 0), ("x2", 0), (None, 0)))
    assert (put.written, put.replaced, put.compacted) == (2, 3, False) and rows(put.rows) == [("x1", 100), ("x1", 101)]
    want = [r for r in base if r[0] not in ("x1", "x2")] + [("x1", 100), ("x1", 101)]
    assert rows(t.read()) == sorted(want)
    t.put(make(("x1", 102)))  # without keys nothing is replaced
    assert rows(t.read()) == sorted(want + [("x1", 102)])
    held = t.read()
    assert t.put(make(*[("y", i) for i in range(20)]), make(("x3", 0))).compacted and len(t.log()) == 1
    want = [r for r in want if r[0] != "x3"] + [("x1", 102)] + [("y", i) for i in range(20)]
    assert rows(t.read()) == sorted(want) and held.count() == len(want) - 19


def test_versions_of_a_run_that_never_ended_count_for_nothing(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    table(spark, tmp_path, "a").put(make(("x", 1), ("y", 1)))
    table(spark, tmp_path, "lost", ["a"]).put(make(("x", 2)), make(("x", 0), ("y", 0)))
    again = table(spark, tmp_path, "b", ["a"])
    assert rows(again.read()) == [("x", 1), ("y", 1)]
    again.put(make(("x", 3)), make(("x", 0)))
    assert rows(table(spark, tmp_path, "c", ["a", "b"]).read()) == [("x", 3), ("y", 1)]


def test_many_versions_equal_a_dictionary(spark, tmp_path, monkeypatch):
    r, want = random.Random(2), {}
    for i in range(5):
        rows_ = [(f"k{r.randrange(60)}", r.randrange(99)) for _ in range(200 if i == 0 else 6)]
        keys = {k for k, _ in rows_} | {f"k{r.randrange(60)}" for _ in range(3)}
        want = {k: v for k, v in want.items() if k not in keys}
        for k, n in rows_:
            want.setdefault(k, []).append(n)
        table(spark, tmp_path).put(spark.createDataFrame(rows_, SCHEMA), spark.createDataFrame([(k, 0) for k in keys], SCHEMA))
    assert rows(table(spark, tmp_path).read()) == sorted((k, n) for k, ns in want.items() for n in ns)

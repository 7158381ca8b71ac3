"""Every query of the catalog against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__
from factloom.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.execute(oracles.ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got = bag(found.columns, found.collect())
    assert got and got == bag(names, wanted.fetchall())


def test_every_query_has_sql_but_these():
    assert set(catalog.QUERIES) - set(oracles.ORACLES) == {"line_diff", "context_financials"}


def common_lines(a: list[str], b: list[str]) -> str:
    """Steps of a longest common subsequence by the textbook table: = keep, - drop, + add."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    i = j = 0
    steps = ""
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            steps, i, j = steps + "=", i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            steps, i = steps + "-", i + 1
        else:
            steps, j = steps + "+", j + 1
    return steps + "-" * (len(a) - i) + "+" * (len(b) - j)


def test_line_diff_against_the_textbook_table(spark):
    pairs = {r.doc_id: (r.before, r.after) for r in catalog._edited(catalog.Tables(spark, SF)).collect()}
    got = {}
    for r in catalog.QUERIES["line_diff"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    for key, (before, after) in pairs.items():
        a, b = before.replace("\r\n", "\n").split("\n"), after.replace("\r\n", "\n").split("\n")
        steps = common_lines(a, b)
        own = sorted(got.get(key, []), key=lambda r: (r.before_from, r.after_from))
        assert sum(r.before_to - r.before_from for r in own) == steps.count("-") and sum(r.after_to - r.after_from for r in own) == steps.count("+")


def test_financials_against_plain_sums(spark):
    rows = {(r.part, r.place): r.line for r in catalog.QUERIES["context_financials"](spark, SF).collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    # Facts are one per order: the last observation in the order of ids tells amount and type.
    facts = len({r.l_orderkey for r in lines})
    assert rows[0, "0000"] == f"- Payment facts: {facts}" and rows[0, "0006"] == "### Recent Payments"
    assert sum(part == 2 for part, _ in rows) == min(30, facts)


def test_numbered_lines_are_those_of_the_whole_sections(spark):
    context = catalog._context(catalog.Tables(spark, SF))
    whole = {r.section_id: (r.title, r.content) for r in context.build().collect()}
    lines = {}
    for r in sorted(context.numbered().collect(), key=lambda r: r.line_no):
        lines.setdefault(r.section_id, []).append((r.line_no, r.line))
    # The stand-in index has no property and so no profile.
    assert len(whole) == 13 and set(lines) == set(whole)
    for section, (title, content) in whole.items():
        assert [n for n, _ in lines[section]] == list(range(1, len(lines[section]) + 1))
        assert "\n".join([f"## {title}", "", *[x for _, x in lines[section]]]).rstrip() == content.rstrip()


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0

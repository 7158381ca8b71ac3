"""What items and sources relate to is counted by node: the same as of all candidates written out, whatever nodes are hot."""

from __future__ import annotations

import random

import pytest

from factloom.operators import linking


@pytest.fixture(scope="module")
def related(spark):
    r = random.Random(7)
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(20)} | {("n0", "n1"), ("n1", "n0")})
    direct = [(f"s{i}", r.choice(["n0", "n0", *nodes]), r.choice(["2020-01-01", None])) for i in range(30)]
    index = spark.createDataFrame([(n, "property" if i % 3 == 0 else "email" if i % 3 == 1 else "tenant") for i, n in enumerate(nodes[:10])], "entity_id string, entity_type string")
    items = spark.createDataFrame([(f"w{i % 4}", f"s{i}") for i in range(30)] + [("w1", "s1"), ("w2", "s1")], "work_item_id string, source_id string")
    return spark.createDataFrame(direct + direct[:3], "source_id string, entity_id string, day string"), spark.createDataFrame(edges, "from_id string, to_id string"), index, items


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr(linking, "HOT_ROWS", 3)
    monkeypatch.setattr(linking, "HOT_OTHERS", 2)
    monkeypatch.setattr(linking, "TASK_ROWS", 10)


def test_items_of_hot_nodes(spark, related, hot):
    direct, edges, _, items = related
    found = linking.item_relations(items, linking.reached(direct, edges))
    # No edge of a hot node is met by sorting its rows in one task.
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    wanted = linking.item_candidates(items, linking.expand(direct, edges))
    assert rows(found) == rows(wanted.select(*found.columns))


def test_records_of_hot_nodes(spark, related, hot):
    direct, edges, index, _ = related
    sources = direct.select("source_id").distinct().union(spark.createDataFrame([("none",)], "source_id string"))
    told = linking.relation_records(sources, linking.reached(direct, edges), index, "n3")
    wanted = linking.link_records(sources, linking.expand(direct, edges), index, "source_id", "n3")
    assert rows(told) == rows(wanted) and {r.decision for r in told.collect()} >= {"linked", "unlinked"}

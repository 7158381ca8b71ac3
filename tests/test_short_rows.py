"""Facts reduced from short rows: the same as from observations, and shuffled only by the join that the rows come from."""

from __future__ import annotations

from factloom.operators import facts
from factloom.plans import catalog

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_facts_of_short_rows_equal_those_of_observations(spark):
    t = catalog.Tables(spark, SF)
    for part, most in ((catalog._payment_part(t), 2), (catalog._invoice_part(t), 1)):
        found = part.facts()
        assert exchanges(found) == most
        wanted = facts.reduce_observations(part.told(), facts.SCOPED)
        assert sorted(map(repr, found.select(*wanted.columns).collect())) == sorted(map(repr, wanted.collect()))


def test_fields_of_a_text_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    from factloom.functions import naming

    plan = spark.createDataFrame([("x",)], "p string").select(naming.invoice_fields(F.col("p")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    # The text is normalized once, not once for each pattern and each time that a field is read.
    assert plan.count("regexp_replace(p#") <= 2


def test_texts_of_ascii_are_folded_by_one_table(spark):
    from pyspark.sql import functions as F

    from factloom.functions import text

    rows = spark.createDataFrame([("  a  ,B, ,c1 . -\t",), ("Äß́ ﬁ_x; é̀",), ("",), (None,)], "t string")
    found = rows.select(text.fold_search(F.col("t")).alias("f"))
    assert [r.f for r in found.collect()] == ["a b c1 . -", "ass fi_x e", "", None]
    # No ranges of letters are asked one after another for each character.
    assert "a-z0-9" not in found._jdf.queryExecution().optimizedPlan().toString()

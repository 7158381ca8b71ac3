"""What differs between two sets of facts, and the views that this touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.entities import is_viewed

# The section that shows each kind of fact, and the places of views.
SECTIONS = {
    "property_profile": "property-profile", "building": "buildings", "unit": "units", "owner": "owners", "tenant": "tenants", "contractor": "contractors", "payment": "financials", "invoice": "invoices",
    "document": "documents", "decision": "documents", "communication": "communications-review", "communication_event": "communications-review", "issue": "current-open-issues", "deadline": "current-open-issues",
    "obligation": "current-open-issues", "risk": "risks-needs-review", "review_item": "risks-needs-review", "status_change": "recent-important-changes",
}
OTHER_SECTION = "provenance"
VIEW_ROOT = "contexts"
# End of fixed values.


def section_of(kind: Column) -> Column:
    pairs = [F.lit(x) for item in SECTIONS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(OTHER_SECTION))


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def compare(previous: DataFrame, following: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, status) of all rows of both: added, removed, modified or unchanged."""
    before = previous.select(key, fingerprint(compared).alias("before"))
    after = following.select(key, fingerprint(compared).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged")
    return before.join(after, key, "full_outer").select(key, status.alias("status"))


def change_set(previous: DataFrame, following: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, status) of rows that were added, removed or modified; equal ones are left out."""
    return compare(previous, following, key, compared).where("status <> 'unchanged'")


def change_summary(compared: DataFrame) -> DataFrame:
    """One row: rows before and after, and how many were added, removed, modified or stayed."""
    n = lambda *states: F.count_if(F.col("status").isin(*states))
    return compared.agg(
        n("removed", "modified", "unchanged").alias("previous"), n("added", "modified", "unchanged").alias("following"), *[n(s).alias(s) for s in ("added", "removed", "modified", "unchanged")]
    )


def changed_entities(changed: DataFrame, property_id: str) -> DataFrame:
    """(entity_id) that changed facts (subject_id, primary_entity_id, from_entity_id, to_entity_id, entities) concern, and the property."""
    ends = F.array("subject_id", "primary_entity_id", "from_entity_id", "to_entity_id", F.lit(property_id))
    every = changed.select(F.explode(F.array_union(F.coalesce("entities", F.array().cast("array<string>")), ends)).alias("entity_id"))
    return every.where("entity_id IS NOT NULL AND entity_id <> ''").distinct()


def changed_sources(changed: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id) of changed facts, by the rows of ``fact_sources``."""
    return sources.join(changed.select("fact_id"), "fact_id", "left_semi").select("source_id").distinct()


def affected_views(changed: DataFrame, touched: DataFrame, index: DataFrame, property_id: str) -> DataFrame:
    """(view) of changed facts: each one's section, the page of each entity of a viewed type, and the manifest if anything changed.

    ``changed``: facts with ``kind``; ``touched``: entity_id of the entities that they concern.
    """
    root = f"{VIEW_ROOT}/{property_id}"
    sections = changed.select(F.concat(F.lit(f"{root}/Context.md#"), section_of(F.col("kind"))).alias("view"))
    viewed = index.where(is_viewed(F.col("entity_type")) & (F.col("entity_id") != property_id)).select("entity_id")
    pages = touched.join(viewed, "entity_id", "left_semi").select(F.concat(F.lit(f"{root}/entities/"), "entity_id", F.lit(".md")).alias("view"))
    manifest = changed.select(F.lit(f"{root}/view-manifest.json").alias("view"))
    return sections.unionByName(pages).unionByName(manifest).distinct()

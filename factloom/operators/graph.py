"""The entity graph: typed nodes, edges between kept nodes, and the neighbourhood of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Types of nodes, most nodes in all, of one type, linked to that type, around a focus, at the start; most edges.
NODE_TYPES = ("property", "building", "unit", "owner", "tenant", "contractor")
MOST_NODES = {"all": 42, "type": 22, "type_linked": 28, "focus": 16, "start": 10}
MOST_EDGES = 90
# End of fixed values.


def context_nodes(index: DataFrame, facts: DataFrame, touched: DataFrame) -> DataFrame:
    """(id, label, type) of entities of NODE_TYPES, of invoices to be reviewed and of contractors that invoices concern.

    ``facts``: fact_id, kind, subject_id, decision; ``touched``: fact_id, entity_id.
    """
    typed = index.where(F.col("entity_type").isin(*NODE_TYPES)).select("entity_id")
    reviewed = facts.where("kind = 'invoice' AND decision <> 'keep' AND subject_id IS NOT NULL").select(F.col("subject_id").alias("entity_id"))
    invoices = facts.where("kind = 'invoice'").select("fact_id")
    paid = touched.join(invoices, "fact_id", "left_semi").select("entity_id").join(index.where("entity_type = 'contractor'").select("entity_id"), "entity_id", "left_semi")
    chosen = typed.unionByName(reviewed).unionByName(paid).distinct()
    return index.join(chosen, "entity_id", "left_semi").select(F.col("entity_id").alias("id"), F.coalesce(F.nullif("name", F.lit("")), "entity_id").alias("label"), F.col("entity_type").alias("type"))


def context_edges(index: DataFrame, facts: DataFrame, touched: DataFrame) -> DataFrame:
    """(from_id, to_id, label): relations of the index, relationship facts, and what invoices concern."""
    related = index.select(F.col("entity_id").alias("from_id"), F.explode("related").alias("to_id"), F.lit("related").alias("label"))
    told = facts.where("kind = 'relationship'").select(F.col("from_entity_id").alias("from_id"), F.col("to_entity_id").alias("to_id"), F.coalesce("relationship_type", F.lit("relationship")).alias("label"))
    invoices = facts.where("kind = 'invoice' AND subject_id IS NOT NULL").select("fact_id", F.col("subject_id").alias("from_id"))
    linked = invoices.join(touched, "fact_id").select("from_id", F.col("entity_id").alias("to_id"), F.lit("invoice_link").alias("label"))
    return related.unionByName(told).unionByName(linked)


def edges_between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges (from_id, to_id, label) without loops, both ends among ``nodes`` (id)."""
    start, end = nodes.select(F.col("id").alias("from_id")), nodes.select(F.col("id").alias("to_id"))
    return edges.where("from_id <> to_id").join(start, "from_id", "left_semi").join(end, "to_id", "left_semi").select("from_id", "to_id", "label").distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, focus: str, most_nodes: int = MOST_NODES["all"], most_edges: int = MOST_EDGES, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes one step around ``focus``, either way, of ``types`` if given, and the edges among them."""
    other = F.when(F.col("from_id") == focus, F.col("to_id")).otherwise(F.col("from_id"))
    near = edges.where((F.col("from_id") == focus) | (F.col("to_id") == focus)).select(other.alias("id")).distinct()
    around = nodes.join(near, "id", "left_semi").where(F.col("id") != focus)
    around = around if types is None else around.where(F.col("type").isin(*types))
    kept = around.orderBy("type", "id").limit(most_nodes - 1).unionByName(nodes.where(F.col("id") == focus))
    return kept, edges_between(kept, edges).orderBy("from_id", "to_id", "label").limit(most_edges)


def relation_notes(edges: DataFrame, most: int = 3) -> DataFrame:
    """(from_id, label, note): the first ``most`` ends per node and label, joined."""
    rank = F.row_number().over(Window.partitionBy("from_id", "label").orderBy("to_id"))
    first = edges.withColumn("rank", rank).where(F.col("rank") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "to_id"))), lambda x: x["to_id"])
    return first.groupBy("from_id", "label").agg(F.array_join(listed, ", ").alias("note"))

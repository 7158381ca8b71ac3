"""Facts: observations of one kind and subject, reduced in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions.text import json_id
from factloom.operators.rounds import numbered

# Decisions from the one that prevails to the weakest, kinds of facts by kinds of observations and of
# entities, observation kinds that are facts as they are, the attribute that names each kind's subject.
DECISIONS = ("keep", "needs_review", "duplicate", "ignore")
SEMANTIC_KINDS = ("issue", "decision", "obligation", "deadline", "risk", "status_change", "communication_event")
FACT_KINDS = {
    "relationship": "relationship", "maintenance_issue": "issue", "meeting_decision": "decision", "payment": "payment", "invoice": "invoice", "document_metadata": "document",
    "communication_metadata": "communication", "source_bundle": "source_bundle",
}
ENTITY_KINDS = {"property": "property_profile", "building": "building", "unit": "unit", "owner": "owner", "tenant": "tenant", "contractor": "contractor"}
SUBJECTS = {"entity_profile": ("entityId",), "payment": ("transactionId",), "invoice": ("invoiceId",), "document_metadata": ("letterId",)}
RELATION_SUBJECT = ("relationshipType", "fromEntityId", "toEntityId", "validFrom")
# End of fixed values.

#: The attributes that facts are made of.
ATTRIBUTES = "entityId string, entityType string, relationshipType string, fromEntityId string, toEntityId string, validFrom string, validTo string, transactionId string, invoiceId string, letterId string, threadId string, emailId string, subjectId string, primaryEntityId string, eventDate string, date string, dueDate string, entities array<string>"
SCOPED = ("primary_entity_id", "event_date", "valid_from", "valid_to", "due_date", "relationship_type", "from_entity_id", "to_entity_id", "entity_id")


def decision_rank(decision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DECISIONS)), decision)


def decision_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DECISIONS)), rank.cast("int"))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def fact_kind(kind: Column, entity_type: Column) -> Column:
    """The kind of fact that an observation gives; what has none is to be reviewed."""
    profile = F.coalesce(F.element_at(_map(ENTITY_KINDS), entity_type), F.lit("review_item"))
    return F.when(kind == "entity_profile", profile).when(kind.isin(*SEMANTIC_KINDS), kind).otherwise(F.coalesce(F.element_at(_map(FACT_KINDS), kind), F.lit("review_item")))


def fact_subject(kind: Column, a, statement: Column, mentions: Column, source_id: Column, work_item_id: Column) -> Column:
    """What an observation is about: the id that its kind names, else its first mention, else its source.

    ``a``: the attribute of a name, null if blank.
    """
    made = json_id("SUBJECT", statement=statement, sourceIds=F.array(source_id))
    chain = F.when(kind == "relationship", F.nullif(F.concat_ws(":", *map(a, RELATION_SUBJECT)), F.lit("")))
    for name, fields in SUBJECTS.items():
        chain = chain.when(kind == name, F.coalesce(*map(a, fields)))
    chain = chain.when(kind == "communication_metadata", F.coalesce(a("threadId"), a("emailId"), work_item_id))
    chain = chain.when(kind.isin(*SEMANTIC_KINDS), F.coalesce(a("subjectId"), a("primaryEntityId"), made))
    return chain.otherwise(F.coalesce(F.get(mentions, F.lit(0)), source_id))


def scoped(observations: DataFrame) -> DataFrame:
    """Observations with fact_kind, subject_id and the SCOPED fields; ``entities`` names all that they concern.

    Attributes are read once per observation.
    """
    read = observations.withColumn("_a", F.from_json("attributes", ATTRIBUTES))
    a = lambda n: F.when(F.trim(F.col(f"_a.{n}")) != "", F.col(f"_a.{n}"))
    subject = fact_subject(F.col("kind"), a, F.col("statement"), F.col("mentions"), F.col("source_id"), F.col("work_item_id"))
    told = read.withColumns({"fact_kind": fact_kind(F.col("kind"), a("entityType")), "subject_id": subject})
    listed = F.array_union(F.coalesce("_a.entities", F.array().cast("array<string>")), F.array_append("mentions", F.col("subject_id")))
    return told.withColumns(
        {
            "entities": F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != ""))), "primary_entity_id": F.coalesce(a("primaryEntityId"), "subject_id"), "event_date": F.coalesce(a("eventDate"), a("date")),
            "valid_from": a("validFrom"), "valid_to": a("validTo"), "due_date": a("dueDate"), "relationship_type": a("relationshipType"), "from_entity_id": a("fromEntityId"), "to_entity_id": a("toEntityId"), "entity_id": a("entityId"),
        }
    ).drop("_a")


def subjects(observations: DataFrame) -> DataFrame:
    """Observations with the fact_kind and subject_id that they are reduced by."""
    told = scoped(observations)
    return told.select(*observations.columns, "fact_kind", "subject_id")


def reduce_observations(observations: DataFrame, fields: tuple[str, ...] = ("event_date", "primary_entity_id")) -> DataFrame:
    """One fact per kind and subject_id, of observations that aren't ignored or duplicates.

    In the order of phase, then observation id: id and statement come from the first, attributes from the last, each
    of ``fields`` from the first that has one; the prevailing decision wins.  Sources stay rows, see ``fact_sources``:
    here are their number and the first by name, so that a subject with very many sources is one short row.
    """
    used = observations.where(~F.col("decision").isin("ignore", "duplicate"))
    order = F.struct("phase", "observation_id")
    first_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    # Rows of one observation, one for each of its sources, count once.
    once = used.groupBy("kind", "subject_id", "phase", "observation_id").agg(
        F.min(F.struct("statement", "attributes", *fields)).alias("o"), F.min(decision_rank(F.col("decision"))).alias("rank"), F.count("*").alias("sources"), F.min("source_id").alias("first_source")
    )
    grouped = once.select("kind", "subject_id", "phase", "observation_id", "o.*", "rank", "sources", "first_source").groupBy("kind", "subject_id").agg(
        F.min_by("statement", order).alias("statement"), F.max_by("attributes", order).alias("attributes"), *[first_of(c).alias(c) for c in fields],
        F.count("*").alias("merged"), F.min("rank").alias("rank"), F.sum("sources").alias("source_count"), F.min("first_source").alias("first_source"),
    )
    return grouped.select(
        json_id("FACT", kind=F.col("kind"), subjectId=F.col("subject_id"), statement=F.col("statement")).alias("fact_id"),
        "kind", "subject_id", "statement", "attributes", *fields, "source_count", "first_source", "merged", decision_of(F.col("rank")).alias("decision"),
    )


def reduce_rows(rows: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], fields: tuple[str, ...] = ("event_date", "primary_entity_id"), whole: bool = True) -> DataFrame:
    """``reduce_observations`` of ``made(rows)``, observations whose texts are far longer than the rows, with ``key``.

    ``key``: a column that is equal for rows of one kind and subject_id and different for others.  Rows that stand
    together by it already, as behind a join on it, aren't shuffled again.  Only the rows are sorted and grouped: statement
    and attributes (these unless not ``whole``) are made again from the first and the last row of a fact.
    """
    told = scoped(made(rows.select("*", F.col(key).alias("together"), F.struct(*rows.columns).alias("carried")))).withColumn("kind", F.col("fact_kind"))
    used = told.where(~F.col("decision").isin("ignore", "duplicate"))
    order = F.struct("phase", "observation_id")
    first_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    once = used.groupBy("together", "kind", "subject_id", "phase", "observation_id").agg(
        F.min(F.struct("carried", *fields)).alias("o"), F.min(decision_rank(F.col("decision"))).alias("rank"), F.count("*").alias("sources"), F.min("source_id").alias("first_source")
    )
    flat = once.select("together", "kind", "subject_id", "phase", "observation_id", "o.*", "rank", "sources", "first_source")
    grouped = flat.groupBy("together", "kind", "subject_id").agg(
        F.min_by("carried", order).alias("_first"), *([F.max_by("carried", order).alias("_last")] if whole else []), *[first_of(c).alias(c) for c in fields],
        F.count("*").alias("merged"), F.min("rank").alias("rank"), F.sum("sources").alias("source_count"), F.min("first_source").alias("first_source"),
    )
    for end, text in {"_first": "statement", "_last": "attributes"}.items():
        if end in grouped.columns:
            others = [c for c in grouped.columns if c not in (end, "together")]
            grouped = made(grouped.select(f"{end}.*", "together", F.struct(*others).alias("carried"))).select("together", "carried.*", text)
    return grouped.select(
        json_id("FACT", kind=F.col("kind"), subjectId=F.col("subject_id"), statement=F.col("statement")).alias("fact_id"),
        "kind", "subject_id", "statement", *(["attributes"] if whole else []), *fields, "source_count", "first_source", "merged", decision_of(F.col("rank")).alias("decision"), F.col("together").alias(key),
    )


def reduce_touched(before: DataFrame, observations: DataFrame, touched: DataFrame, fields: tuple[str, ...] = ("event_date", "primary_entity_id")) -> DataFrame:
    """The facts after some subjects' observations changed: those of ``touched`` (kind, subject_id) reduced again, others as ``before``."""
    key = ["kind", "subject_id"]
    return replace_touched(before, touched.select(*key).distinct(), key, lambda keys: reduce_observations(observations.join(keys, key, "left_semi"), fields))


def replace_touched(before: DataFrame, touched: DataFrame, key: list[str], reduced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``before`` without the facts of ``touched`` (distinct keys), and those that ``reduced`` gives for these."""
    again = reduced(touched)
    return before.join(touched, key, "left_anti").select(*again.columns).unionByName(again)


def fact_sources(observations: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, source_id) of every source that supports a fact, each once."""
    used = observations.where(~F.col("decision").isin("ignore", "duplicate")).select("kind", "subject_id", "source_id")
    return used.join(facts.select("kind", "subject_id", "fact_id"), ["kind", "subject_id"]).select("fact_id", "source_id").distinct()


def fact_entities(observations: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, entity_id) of every entity that a fact concerns, each once.  ``observations``: with ``entities``."""
    used = observations.where(~F.col("decision").isin("ignore", "duplicate")).select("kind", "subject_id", F.explode("entities").alias("entity_id")).distinct()
    return used.join(facts.select("kind", "subject_id", "fact_id"), ["kind", "subject_id"]).select("fact_id", "entity_id")


def fact_evidence(observations: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, place, evidence): the distinct pieces of evidence in the order of the observations."""
    used = observations.where(~F.col("decision").isin("ignore", "duplicate")).select("kind", "subject_id", F.struct("phase", "observation_id", "source_id").alias("o"), F.posexplode("evidence").alias("n", "evidence"))
    first = used.groupBy("kind", "subject_id", "evidence").agg(F.min(F.struct("o", "n")).alias("place"))
    return first.join(facts.select("kind", "subject_id", "fact_id"), ["kind", "subject_id"]).select("fact_id", "place", "evidence")


def first_values(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, values): the first ``k`` values of each key in order; only these are gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    kept = rows.select(key, value).withColumn("_rank", rank).where(F.col("_rank") <= k)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def build_facts(observations: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, sources, entities, evidence) of observations with ``phase``.

    Attributes of profiles have the entity of the index besides; ``merged`` counts the observations of a fact.
    """
    told = scoped(observations.drop("fact_kind", "subject_id")).withColumn("kind", F.col("fact_kind"))
    facts = reduce_observations(told, SCOPED)
    known = index.select(F.col("entity_id").alias("_id"), F.to_json(F.struct("entity_id", "entity_type", "name", "related", "fields")).alias("canonical_entity"))
    joined = facts.join(known, F.col("entity_id") == F.col("_id"), "left").drop("_id", "entity_id")
    return joined, fact_sources(told, facts), fact_entities(told, facts), fact_evidence(told, facts)


def ordered(facts: DataFrame) -> DataFrame:
    """Facts with their ``place`` in the order of kind and subject, as Unicode collates them, then of id."""
    return numbered(facts, [F.collate(F.concat_ws(":", "kind", F.coalesce("subject_id", "fact_id")), "UNICODE"), F.col("fact_id")])


def fact_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind").agg(F.count("*").alias("facts"))


def last_per_subject(facts: DataFrame, subject: str, value: str, order: list[str]) -> DataFrame:
    return facts.groupBy(subject).agg(F.max_by(value, F.struct(*order)).alias(value))


def by_entity(facts: DataFrame, ends: list[str], list_end: str | None = None) -> DataFrame:
    """A row per fact and entity that it concerns through any of its ends: equal keys instead of alternatives."""
    own = F.array(*ends)
    every = own if list_end is None else F.array_union(own, F.coalesce(F.col(list_end), F.array().cast("array<string>")))
    return facts.withColumn("entity_id", F.explode(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))))

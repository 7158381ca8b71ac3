"""Entities with their aliases and relations: master data, index rows and documents as typed selections put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import naming
from factloom.functions.text import missing_if_blank, trim

# Types whose views are written, parts of paths and prefixes of ids that tell a master record's type, the
# columns of master data and indexes that become aliases.
VIEWED = ("property", "building", "unit", "owner", "tenant", "contractor", "invoice", "letter")
MASTER_TYPES = (("unit", "einheiten", "EH-"), ("owner", "eigentuemer", "EIG-"), ("tenant", "mieter", "MIE-"), ("contractor", "dienstleister", "DL-"), ("building", "gebaeude", "HAUS-"))
CONTACT_ALIASES = {"email": "email", "phone": "telefon", "iban": "iban"}
INDEX_FILES = {"emails_index.csv": "email", "rechnungen_index.csv": "invoice", "bank_index.csv": "transaction"}
# End of fixed values.

ENTITY = "entity_id string, entity_type string, name string, related array<string>, fields map<string,string>, priority int, place string"


def is_viewed(entity_type: Column) -> Column:
    return entity_type.isin(*VIEWED)


def entity_type(path: Column, entity_id: Column) -> Column:
    """The type of a master record: what its file's path or its id's prefix tells; ``entity`` if neither does."""
    path, chain = F.lower(path), None
    for kind, part, prefix in MASTER_TYPES:
        fits = path.contains(part) | F.coalesce(entity_id.startswith(prefix), F.lit(False))
        chain = F.when(fits, kind) if chain is None else chain.when(fits, kind)
    return chain.when(entity_id.startswith("LIE-"), "property").otherwise("entity")


def present(c: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(trim(c) != "", c)


def display_name(name: Column, company: Column, given: Column, family: Column, entity_id: Column) -> Column:
    """The first that there is: name, company, full name, id; else ``unknown``."""
    person = missing_if_blank(F.concat_ws(" ", present(given), present(family)))
    return F.coalesce(present(name), present(company), person, present(entity_id), F.lit("unknown"))


def typed(rows: DataFrame, entity_id: Column, kind: str | Column, name: Column, related: Column | None = None, priority: int = 0, fields: Column | None = None, place: Column | None = None) -> DataFrame:
    """One selection of entities; of several for an id, the one of the highest priority and then of the last place counts."""
    none = F.array().cast("array<string>")
    links = F.array_distinct(F.filter(none if related is None else related, lambda x: x.isNotNull() & (x != "")))
    return rows.select(
        entity_id.cast("string").alias("entity_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("entity_type"), name.alias("name"), links.alias("related"),
        (F.create_map().cast("map<string,string>") if fields is None else fields).alias("fields"), F.lit(priority).alias("priority"), (F.lit("") if place is None else place).alias("place"),
    )


def _all(selections: tuple[DataFrame, ...]) -> DataFrame:
    every = selections[0]
    for more in selections[1:]:
        every = every.unionByName(more)
    return every


def entity_index(*selections: DataFrame) -> DataFrame:
    """(entity_id, entity_type, name, related, fields): one row per id."""
    order = F.struct("priority", "place", "entity_type", "name", "related")
    best = _all(selections).groupBy("entity_id").agg(F.max_by(F.struct("entity_type", "name", "related", "fields"), order).alias("e"))
    return best.select("entity_id", "e.entity_type", "e.name", "e.related", "e.fields")


def entity_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("entity_type").agg(F.count("*").alias("entities"))


def aliases(*selections: DataFrame) -> DataFrame:
    """(alias_key, alias, entity_id, alias_type) of selections (alias, entity_id, alias_type), each once; blanks go."""
    keyed = _all(selections).withColumn("alias_key", F.lower(trim(F.col("alias"))))
    return keyed.where(F.col("alias_key") != "").dropDuplicates(["alias_key", "alias", "entity_id", "alias_type"]).select("alias_key", "alias", "entity_id", "alias_type")


def only_new(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Entities that ``known`` lacks: those derived from files fill gaps only."""
    return rows.join(known.select("entity_id"), "entity_id", "left_anti")


def relation_edges(index: DataFrame) -> DataFrame:
    """(from_id, to_id) of every relation whose end is an entity."""
    pairs = index.select(F.col("entity_id").alias("from_id"), F.explode("related").alias("to_id"))
    return pairs.join(index.select(F.col("entity_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id").distinct()


def _place(rows: DataFrame) -> Column:
    return F.concat_ws(":", "file_name", F.lpad(F.col("line_no").cast("string"), 12, "0"))


def master_entities(records: DataFrame, property_id: str) -> DataFrame:
    """Selections of master records (file_name, field, line_no, row) whose ``field`` names their type.

    Buildings relate to the property and it to them, units to their building, owners to their units, tenants to
    their unit and owner.
    """
    r = lambda c: F.col("row")[c]
    part = lambda field: records.where((F.col("field") == field) & present(r("id")).isNotNull())
    buildings = part("gebaeude").agg(F.array_sort(F.collect_set(r("id"))).alias("buildings"))
    person = F.coalesce(present(r("firma")), missing_if_blank(F.concat_ws(" ", present(r("vorname")), present(r("nachname")))), r("id"))
    units = F.filter(F.transform(F.split(F.coalesce(r("einheit_ids"), F.lit("")), "[;,]"), trim), lambda x: x != "")
    made = lambda field, kind, name, related: typed(part(field), r("id"), kind, name, related, 2, F.col("row"), _place(records))
    house = typed(part("liegenschaft").join(F.broadcast(buildings)), r("id"), "property", F.coalesce(r("name"), r("id")), F.col("buildings"), 2, F.col("row"), _place(records))
    return _all((
        house,
        made("gebaeude", "building", F.concat(F.lit("Haus "), F.coalesce(r("hausnr"), r("id"))), F.array(F.lit(property_id))),
        made("einheiten", "unit", trim(F.concat_ws(" ", F.coalesce(r("einheit_nr"), r("id")), r("haus_id"))), F.array(present(r("haus_id")))),
        made("eigentuemer", "owner", person, units), made("mieter", "tenant", person, F.array(present(r("einheit_id")), present(r("eigentuemer_id")))),
        made("dienstleister", "contractor", F.coalesce(r("firma"), r("id")), None),
    ))


def index_entities(records: DataFrame) -> DataFrame:
    """Selections of the rows of mail, invoice and bank indexes."""
    r = lambda c: F.col("row")[c]
    known = records.where(F.col("file_name").isin(*INDEX_FILES) & present(r("id")).isNotNull())
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in INDEX_FILES.items() for x in pair]), F.col("file_name"))
    booked = trim(F.concat(F.coalesce(r("datum"), F.lit("")), F.lit(" "), F.coalesce(r("gegen_name"), F.lit("")), F.lit(" "), F.coalesce(r("betrag"), F.lit(""))))
    name = F.when(kind == "email", missing_if_blank(r("subject"))).when(kind == "invoice", missing_if_blank(r("rechnungsnr"))).otherwise(missing_if_blank(booked))
    related = F.when(kind == "invoice", F.array(present(r("dienstleister_id")))).when(kind == "transaction", F.array(present(r("referenz_id")))).otherwise(F.array().cast("array<string>"))
    return typed(known, r("id"), kind, F.coalesce(name, r("id")), related, 1, F.col("row"), _place(records))


def document_entities(registry: DataFrame) -> DataFrame:
    """Selections of the mails, invoices and letters that sources declare, under the file's name; invoices relate to contractors."""
    usable = registry.where(~F.col("status").isin("deleted", "ignored", "duplicate"))
    first = lambda p: F.get(F.filter("declared_ids", lambda x: x.startswith(p)), F.lit(0))
    kinds = F.array(*[F.struct(first(p).alias("id"), F.lit(k).alias("kind")) for p, k in (("EMAIL-", "email"), ("INV-", "invoice"), ("LTR-", "letter"))])
    each = usable.select("*", F.explode(kinds).alias("e")).where("e.id IS NOT NULL")
    related = F.when(F.col("e.kind") == "invoice", F.filter("declared_ids", lambda x: x.startswith("DL-"))).otherwise(F.array().cast("array<string>"))
    fields = F.map_filter(F.create_map(F.lit("sourceId"), F.col("source_id"), F.lit("rawPath"), F.col("path"), F.lit("sourceDate"), F.col("source_date")), lambda _, v: v.isNotNull())
    # Of several sources of one id the first in path order counts.
    first_path = each.groupBy("e.id", "e.kind").agg(F.min("path").alias("path"))
    one = each.join(first_path, (F.col("e.id") == first_path["id"]) & (F.col("e.kind") == first_path["kind"]) & (each["path"] == first_path["path"]), "left_semi")
    return typed(one, F.col("e.id"), F.col("e.kind"), naming.file_name(F.col("path")), related, 0, fields, F.col("path"))


def build_index(records: DataFrame, registry: DataFrame, property_id: str) -> DataFrame:
    """The entities of master data and indexes, and of documents that these lack."""
    listed = entity_index(master_entities(records, property_id), index_entities(records))
    documents = entity_index(document_entities(registry))
    return listed.unionByName(only_new(documents, listed))


def build_aliases(index: DataFrame) -> DataFrame:
    """``aliases`` of an index: ids, names, contacts, addresses, unit and invoice numbers, threads and file names."""
    f = lambda c: F.col("fields")[c]
    of = lambda alias, kind, *types: index.where(F.col("entity_type").isin(*types)).select(alias.alias("alias"), "entity_id", F.lit(kind).alias("alias_type"))
    own = [index.select(F.col("entity_id").alias("alias"), "entity_id", F.lit("id").alias("alias_type")), index.select(F.col("name").alias("alias"), "entity_id", F.lit("name").alias("alias_type"))]
    people = [of(f(c), kind, "owner", "tenant", "contractor") for kind, c in CONTACT_ALIASES.items()]
    address = F.concat_ws(", ", present(f("strasse")), present(f("plz")), present(f("ort")))
    return aliases(
        *own, *people, of(address, "address", "property"), of(f("verwalter_email"), "email", "property"), of(f("weg_bankkonto_iban"), "iban", "property"),
        of(F.concat(F.lit("Haus "), F.coalesce(f("hausnr"), F.lit(""))), "address", "building"), of(f("einheit_nr"), "unit_number", "unit"), of(f("ansprechpartner"), "name", "contractor"),
        of(f("thread_id"), "thread_id", "email"), of(f("rechnungsnr"), "invoice_number", "invoice"), of(f("filename"), "filename", "email", "invoice"),
        of(F.when(f("rawPath").isNotNull(), F.col("name")), "filename", "email", "invoice", "letter"),
    )


def related_entities(index: DataFrame) -> DataFrame:
    """(entity_id, related_id, type, name): what an entity relates to, units of a building, owners and tenants of a unit."""
    f = lambda c: F.col("fields")[c]
    back = lambda kind, end: index.where(F.col("entity_type") == kind).select(end.alias("entity_id"), F.col("entity_id").alias("related_id"))
    owned = index.where("entity_type = 'owner'").select(F.explode("related").alias("entity_id"), F.col("entity_id").alias("related_id"))
    ahead = index.select("entity_id", F.explode("related").alias("related_id"))
    every = ahead.unionByName(back("unit", f("haus_id"))).unionByName(owned).unionByName(back("tenant", f("einheit_id"))).where("entity_id <> ''").distinct()
    named = index.select(F.col("entity_id").alias("related_id"), F.col("entity_type").alias("type"), "name")
    return every.join(index.select("entity_id"), "entity_id", "left_semi").join(named, "related_id").select("entity_id", "related_id", "type", "name")

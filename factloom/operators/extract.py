"""Observations: statements about one subject that sources support, with their mentions and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import iso_from_german
from factloom.functions.text import OBSERVED_ID_PATTERN, json_id, mentions, sorted_distinct, split_list, stable_id, trim
from factloom.operators.entities import display_name, entity_type, present
from factloom.operators.rounds import once

OBSERVATION = ["observation_id", "work_item_id", "input_hash", "source_id", "kind", "statement", "mentions", "evidence", "decision", "reason", "processor", "attributes"]
# Reasons.
REASONS = {
    "entity_profile": "Deterministic master-data row extraction.", "relationship": "Deterministic relationship extraction from canonical master data.", "payment": "Deterministic bank/index row extraction.",
    "invoice_row": "Deterministic invoice index row extraction.", "invoice_text": "Deterministic invoice PDF text extraction.", "email": "Deterministic email metadata only; semantic body extraction is reserved for the LLM extractor.",
    "letter": "Deterministic letter PDF text extraction.", "index_row": "Deterministic generic index row extraction.", "bank": "Bank source is registered, but deterministic row extraction is only enabled for normalized JSONL files.",
    "source": "Deterministic source registration observation.", "thread": "Thread-level header glimpse extracted deterministically; email body extraction is reserved for the LLM extractor.",
}
# End of fixed values.

#: Columns of rows that their observations keep, see ``facts.reduce_rows``.
CARRIED = ("together", "carried")
EVIDENCE = "struct<sourceId:string,normalizedPath:string,field:string,lineStart:bigint,lineEnd:bigint,quote:string>"


def optional(prefix: str, value: Column, suffix: str = "") -> Column:
    """A part of a statement that is there only if its value is."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), value, F.lit(suffix))).otherwise("")


def text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def compact(**fields: Column) -> Column:
    """A struct of ``fields`` whose blank texts are null, so that its JSON text leaves them out."""
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def evidence(field: Column | str | None = None, line: Column | None = None) -> Column:
    name = F.lit(field) if isinstance(field, str) or field is None else field
    number = F.lit(None) if line is None else line
    return F.array(F.struct(F.col("source_id").alias("sourceId"), F.col("artifact").alias("normalizedPath"), name.cast("string").alias("field"), number.cast("long").alias("lineStart"), number.cast("long").alias("lineEnd"), F.lit(None).cast("string").alias("quote")).cast(EVIDENCE))


def observe(rows: DataFrame, kind: str, statement: Column, attributes: Column, reason: Column | str, seen: Column, decision: Column | str = "keep", processor: str = "structured_extractor") -> DataFrame:
    """Observations of ``rows`` (source_id, artifact, work_item_id, input_hash); their ids are made of all that they say.

    Mentions are the ids in statement, attributes and source id, sorted.  CARRIED columns stay, if there are any.
    """
    kept = [c for c in CARRIED if c in rows.columns]
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    said = {"statement": statement, "attributes": F.to_json(attributes), "decision": lit(decision), "reason": lit(reason), "evidence": seen}
    made = once(rows, said).select("source_id", "work_item_id", "input_hash", *kept, *said)
    # The id's JSON text ends with that of the attributes, which is written once.
    head = F.to_json(F.struct(F.col("input_hash").alias("inputHash"), F.lit(kind).alias("kind"), F.array("source_id").alias("sourceIds"), "statement"))
    identity = stable_id("OBS", F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"attributes":'), F.col("attributes"), F.lit("}")))
    # None is null; sort_array, unlike array_sort, needs no comparator that is interpreted.
    found = F.sort_array(mentions(F.concat_ws(" ", "statement", "attributes", "source_id"), OBSERVED_ID_PATTERN))
    told = once(made, {"_head": head})
    return told.select(identity.alias("observation_id"), "work_item_id", "input_hash", "source_id", F.lit(kind).alias("kind"), "statement", found.alias("mentions"), "evidence", "decision", "reason", F.lit(processor).alias("processor"), "attributes", *kept)


def _row(c: str) -> Column:
    return F.col("row")[c]


def entity_profiles(records: DataFrame) -> DataFrame:
    """Profiles of master records (source_id, path, field, row) that have an id."""
    own = records.where(present(_row("id")).isNotNull())
    kind = entity_type(F.col("path"), _row("id"))
    name = display_name(_row("name"), _row("firma"), _row("vorname"), _row("nachname"), _row("id"))
    statement = text(kind, " ", _row("id"), " (", name, ") is present in canonical master data.")
    return observe(own, "entity_profile", statement, compact(entityId=_row("id"), entityType=kind, fields=F.col("row")), REASONS["entity_profile"], evidence(F.col("field")))


def relationship_rows(records: DataFrame, property_id: str) -> DataFrame:
    """Master records with relation, from_id, to_id, valid_from and valid_to; owners give a row per unit."""
    own = records.where(present(_row("id")).isNotNull()).withColumn("kind", entity_type(F.col("path"), _row("id")))
    none = F.lit(None).cast("string")
    row = lambda relation, a, b, start=none, end=none: F.struct(F.lit(relation).alias("relation"), a.alias("from_id"), b.alias("to_id"), start.alias("valid_from"), end.alias("valid_to"))
    found = (
        F.when(F.col("kind") == "building", F.array(row("property_has_building", F.lit(property_id), _row("id"))))
        .when(F.col("kind") == "unit", F.array(row("unit_in_building", _row("id"), present(_row("haus_id")))))
        .when(F.col("kind") == "owner", F.transform(split_list(F.coalesce(_row("einheit_ids"), F.lit(""))), lambda u: row("owner_owned_unit", _row("id"), u)))
        .when(F.col("kind") == "tenant", F.array(row("tenant_occupied_unit", _row("id"), present(_row("einheit_id")), present(_row("mietbeginn")), present(_row("mietende")))))
    )
    return own.withColumn("r", F.explode(found)).where("r.to_id IS NOT NULL").select("*", "r.*").drop("r")


def relationships(rows: DataFrame, property_id: str) -> DataFrame:
    """Observations of rows with relation, from_id, to_id, valid_from, valid_to."""
    statement = text("Relationship ", F.col("relation"), ": ", F.col("from_id"), " -> ", F.col("to_id"), optional(" from ", F.col("valid_from")), optional(" to ", F.col("valid_to")), ".")
    attributes = compact(
        relationshipType=F.col("relation"), fromEntityId=F.col("from_id"), toEntityId=F.col("to_id"), validFrom=F.col("valid_from"), validTo=F.col("valid_to"), primaryEntityId=F.col("to_id"),
        entities=sorted_distinct(F.array("from_id", "to_id", F.lit(property_id))),
    )
    return observe(rows, "relationship", statement, attributes, REASONS["relationship"], evidence(F.col("field")))


def payment_fields(line_no: Column) -> dict[str, Column]:
    """What an index row or a statement row says of a payment."""
    return {
        "transactionId": F.coalesce(_row("id"), _row("Kundenreferenz (End-to-End)"), F.concat(F.lit("row-"), line_no.cast("string"))), "date": F.coalesce(_row("datum"), iso_from_german(present(_row("Buchungstag"))), F.lit("unknown date")),
        "type": F.coalesce(_row("typ"), _row("Buchungstext"), F.lit("payment")), "amount": F.coalesce(_row("betrag"), _row("Betrag"), F.lit("unknown amount")),
        "counterparty": F.coalesce(_row("gegen_name"), _row("Beguenstigter/Zahlungspflichtiger"), F.lit("unknown counterparty")), "reference": F.coalesce(_row("verwendungszweck"), _row("Verwendungszweck"), F.lit("")),
    }


def payments(records: DataFrame, property_id: str) -> DataFrame:
    """Observations of bank rows (row, line_no); rows with error types are to be reviewed."""
    f = payment_fields(F.col("line_no"))
    statement = text("Payment ", f["transactionId"], " is ", f["type"], " ", f["amount"], " on ", f["date"], " with ", f["counterparty"], optional(" for ", f["reference"]), ".")
    decision = F.when(trim(F.coalesce(_row("error_types"), F.lit(""))) != "", "needs_review").otherwise("keep")
    attributes = compact(
        transactionId=filled(f["transactionId"]), date=filled(f["date"]), eventDate=filled(f["date"]), type=filled(f["type"]), amount=filled(f["amount"]), counterparty=filled(f["counterparty"]), reference=filled(f["reference"]),
        primaryEntityId=filled(f["transactionId"]), entities=F.array(f["transactionId"], F.lit(property_id)), row=F.col("row"),
    )
    return observe(records, "payment", statement, attributes, REASONS["payment"], evidence("jsonl_row", F.col("line_no")), decision)


def invoices(records: DataFrame, property_id: str) -> DataFrame:
    """Observations of invoice rows (row; line_no null for fields read from a text, declared_ids, source_date)."""
    own = lambda p: F.get(F.filter("declared_ids", lambda x: x.startswith(p)), F.lit(0))
    number = F.coalesce(_row("id"), _row("invoiceId"), own("INV-"), "source_id")
    contractor = F.coalesce(_row("dienstleister_id"), _row("contractorId"), own("DL-"), F.lit("unknown contractor"))
    shown = F.coalesce(_row("rechnungsnr"), _row("invoiceNumber"), number)
    gross, net, vat = F.coalesce(_row("brutto"), _row("gross"), _row("grossAmount"), F.lit("unknown gross")), F.coalesce(_row("netto"), _row("netAmount"), F.lit("")), F.coalesce(_row("mwst"), _row("vatAmount"), F.lit(""))
    date = F.coalesce(_row("datum"), _row("date"), "source_date", F.lit("unknown date"))
    statement = text("Invoice ", number, " (", shown, ") is dated ", date, " for ", contractor, " with gross amount ", gross, optional(", net ", net), optional(", VAT ", vat), ".")
    decision = F.when(F.to_json("row").rlike("FAKE|DUP-"), "needs_review").otherwise("keep")
    attributes = compact(
        invoiceId=filled(number), contractorId=filled(contractor), invoiceNumber=filled(shown), date=filled(date), eventDate=filled(date), gross=filled(gross), net=filled(net), vat=filled(vat), primaryEntityId=filled(number),
        entities=sorted_distinct(F.array(number, contractor, F.lit(property_id))), row=F.col("row"),
    )
    listed = F.col("line_no").isNotNull()
    reason = F.when(listed, REASONS["invoice_row"]).otherwise(REASONS["invoice_text"])
    return observe(records, "invoice", statement, attributes, reason, evidence(F.when(listed, "jsonl_row").otherwise("pdf_text"), F.col("line_no")), decision)


def mails(records: DataFrame, property_id: str) -> DataFrame:
    """Observations of mail rows: of an index (id, thread_id, subject, datetime) or of headers (subject, date); always to be reviewed."""
    own = F.get(F.filter("declared_ids", lambda x: x.startswith("EMAIL-")), F.lit(0))
    number, thread = F.coalesce(_row("id"), own, "source_id"), F.coalesce(_row("thread_id"), F.lit(""))
    subject, date = F.coalesce(_row("subject"), F.lit("unknown subject")), F.coalesce(_row("datetime"), _row("date"), "source_date", F.lit("unknown date"))
    statement = text("Email ", number, optional(" in thread ", thread), " is dated ", date, " with subject ", subject, ".")
    attributes = compact(emailId=filled(number), threadId=filled(thread), subject=filled(subject), date=filled(date), eventDate=filled(date), primaryEntityId=filled(number), entities=sorted_distinct(F.array(number, F.lit(property_id))), row=F.col("row"))
    return observe(records, "communication_metadata", statement, attributes, REASONS["email"], evidence(F.when(F.col("line_no").isNotNull(), "jsonl_row").otherwise("email_headers"), F.col("line_no")), "needs_review")


def letters(records: DataFrame, property_id: str) -> DataFrame:
    """Observations of letters: row (letterId, letterType, date, subject, amount) and decisions."""
    own = F.get(F.filter("declared_ids", lambda x: x.startswith("LTR-")), F.lit(0))
    number, kind = F.coalesce(_row("letterId"), own, "source_id"), F.coalesce(_row("letterType"), F.lit("unknown letter type"))
    date, amount = F.coalesce(_row("date"), "source_date", F.lit("unknown date")), F.coalesce(_row("amount"), F.lit(""))
    subject, decided = F.coalesce(_row("subject"), kind), F.coalesce("decisions", F.array().cast("array<string>"))
    about = F.when((subject != "") & (subject != kind), F.concat(F.lit(" about "), subject)).otherwise("")
    counted = F.when(F.size(decided) > 0, F.concat(F.lit(" with "), F.size(decided).cast("string"), F.lit(" extracted meeting decision(s)"))).otherwise("")
    statement = text("Letter ", number, " is a ", kind, " document dated ", date, about, counted, optional(" and amount ", amount), ".")
    attributes = compact(letterId=filled(number), letterType=filled(kind), date=filled(date), eventDate=filled(date), subject=filled(subject), decisions=decided, amount=filled(amount), primaryEntityId=filled(number), entities=sorted_distinct(F.array(number, F.lit(property_id))), row=F.col("row"))
    return observe(records, "document_metadata", statement, attributes, REASONS["letter"], evidence("pdf_text"))


def index_rows(records: DataFrame) -> DataFrame:
    """Observations of rows of an index of no known kind (file_name, line_no, row)."""
    statement = text("Index row ", F.col("line_no").cast("string"), " exists in ", F.col("file_name"), ".")
    return observe(records, "source_bundle", statement, compact(row=F.col("row")), REASONS["index_row"], evidence("jsonl_row", F.col("line_no")))


def bank_sources(sources: DataFrame) -> DataFrame:
    """Observations of bank files whose rows aren't read (source_id, path, file_name)."""
    statement = text("Bank source ", F.col("source_id"), " is available as ", F.col("file_name"), ".")
    return observe(sources, "source_bundle", statement, compact(rawPath=F.col("path"), normalizedPaths=F.array("artifact")), REASONS["bank"], evidence("source_metadata"))


def other_sources(sources: DataFrame) -> DataFrame:
    """Observations of sources of other kinds (source_id, path, source_kind, item_kind, group_key)."""
    statement = text("Source ", F.col("source_id"), " is part of ", F.col("item_kind"), " ", F.col("group_key"), ".")
    return observe(sources, "source_bundle", statement, compact(rawPath=F.col("path"), normalizedPaths=F.array("artifact"), sourceKind=F.col("source_kind")), REASONS["source"], evidence("source_metadata"))


def thread_summaries(items: DataFrame, assigned: DataFrame) -> DataFrame:
    """Observations of mail threads: the work item's summary, once for each of its sources, under one id.

    The id doesn't depend on the source, so that the reduction counts a thread once, whatever its size.
    """
    threads = items.where("kind = 'email_thread'")
    identity = json_id("OBS", inputHash=F.col("input_hash"), kind=F.lit("communication_metadata"), statement=F.col("statement"), attributes=F.col("attributes"))
    one = threads.select("work_item_id", "input_hash", F.col("glimpse.summary").alias("statement"), F.to_json(F.struct("glimpse")).alias("attributes"), F.col("kind").alias("k"), "group_key")
    told = one.select("*", identity.alias("observation_id"), sorted_distinct(mentions(F.concat_ws(" ", "statement", "attributes"), OBSERVED_ID_PATTERN)).alias("mentions"))
    each = told.join(assigned.where("kind = 'email_thread'").select("group_key", "source_id", "artifact"), "group_key")
    return each.select(
        "observation_id", "work_item_id", "input_hash", "source_id", F.lit("communication_metadata").alias("kind"), "statement", "mentions", evidence("email_headers").alias("evidence"), F.lit("needs_review").alias("decision"),
        F.lit(REASONS["thread"]).alias("reason"), F.lit("structured_extractor").alias("processor"), "attributes",
    )


def union(*parts: DataFrame) -> DataFrame:
    """All observations, with ``phase``: the place of the part they come from."""
    every = None
    for phase, part in enumerate(parts):
        rows = part.withColumn("phase", F.lit(phase))
        every = rows if every is None else every.unionByName(rows)
    return every


def camel_row(meta_col: str, **names: str) -> Column:
    """A map of ``meta`` fields under other names, without nulls."""
    pairs = F.create_map(*[x for name, field in names.items() for x in (F.lit(name), F.col(f"{meta_col}.{field}").cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def route(sources: DataFrame, records: DataFrame, items: DataFrame, assigned: DataFrame, property_id: str) -> DataFrame:
    """The observations of every work item, each source by its kind; each kind is a plan of its own.

    ``sources``: registry rows with ``meta``; ``records``: rows of tabular sources; ``items`` and ``assigned``: work
    items and their members.  Mails of a thread are told by their thread only, those of a daily drop one by one.
    """
    member = assigned.select("source_id", F.col("kind").alias("item_kind"), "group_key")
    item = items.select(F.col("kind").alias("item_kind"), "group_key", "work_item_id", "input_hash")
    own = sources.select("source_id", F.col("kind").alias("source_kind"), "path", "declared_ids", "source_date", F.get("normalized_paths", F.lit(0)).alias("artifact"), "meta").join(member, "source_id").join(item, ["item_kind", "group_key"])
    own = own.withColumn("file_name", F.substring_index("path", "/", -1))
    single = own.where("item_kind <> 'email_thread'")
    rows = records.select("source_id", "field", "line_no", "row").join(single, "source_id")
    no_line = F.lit(None).cast("long").alias("line_no")
    master, index, bank = (rows.where(F.col("source_kind") == k) for k in ("master_data", "index_csv", "bank_csv"))
    named = lambda name: index.where(F.col("file_name") == name)
    pdf = lambda kind, row: single.where(F.col("source_kind") == kind).select("*", row.alias("row"), F.col("meta.decisions").alias("decisions"), no_line)
    bill = camel_row("meta", filename="filename", date="date", contractorId="contractor_id", invoiceId="invoice_id", invoiceNumber="invoice_number", customerNumber="customer_number", netAmount="net_amount", vatAmount="vat_amount", grossAmount="gross_amount", iban="iban", title="title")
    letter = camel_row("meta", filename="filename", date="date", letterType="letter_type", letterId="letter_id", subject="subject", meetingDate="meeting_date", amount="amount")
    head = F.map_filter(F.create_map(F.lit("id"), F.col("source_id"), F.lit("subject"), F.col("meta.headers")["subject"], F.lit("date"), F.col("meta.headers")["date"]), lambda _, v: v.isNotNull())
    parts = [
        entity_profiles(master), relationships(relationship_rows(master, property_id).drop("kind"), property_id), payments(named("bank_index.csv"), property_id), payments(bank, property_id),
        invoices(named("rechnungen_index.csv"), property_id), invoices(pdf("invoice_pdf", bill), property_id), mails(named("emails_index.csv"), property_id), mails(pdf("email", head), property_id),
        letters(pdf("letter_pdf", letter), property_id), index_rows(index.where(~F.col("file_name").isin("bank_index.csv", "rechnungen_index.csv", "emails_index.csv"))), bank_sources(single.where("source_kind = 'bank_xml'")),
        other_sources(single.where("source_kind = 'incremental_manifest'")), thread_summaries(items, assigned.join(own.select("source_id", "artifact"), "source_id")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def extraction_summary(items: DataFrame, held: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: work items, those whose earlier observations were used again, those read now, and observations.

    ``held``: the earlier observations that were used again; an observation counts once, whatever its sources.
    """
    again = held.select("work_item_id").distinct().withColumn("again", F.lit(True))
    counts = items.select("work_item_id").join(again, "work_item_id", "left").agg(F.count("*").alias("work_items"), F.count_if("again").alias("reused"))
    total = observations.agg(F.countDistinct("observation_id").alias("observations"))
    return counts.join(F.broadcast(total)).select("work_items", "reused", (F.col("work_items") - F.col("reused")).alias("extracted"), "observations")

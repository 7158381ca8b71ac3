"""The fourteen sections of a property's context, as lines of text made from facts and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import epoch_millis, money_text, parse_number, signed_payment
from factloom.functions.text import NO_ROWS, cell, json_list, json_text, missing_if_blank, source_reference, squeeze
from factloom.operators.facts import SEMANTIC_KINDS, first_values
from factloom.operators.rounds import cut, numbered

# Titles of the sections, columns and fields of the entity tables, limits of lists, words of interest.
TITLES = {
    "property-profile": "Property Profile", "buildings": "Buildings", "units": "Units", "owners": "Owners", "tenants": "Tenants", "contractors": "Contractors", "financials": "Financials", "invoices": "Invoices",
    "documents": "Letters And Documents", "current-open-issues": "Current Open Issues", "recent-important-changes": "Recent Important Changes", "risks-needs-review": "Risks / Needs Review",
    "communications-review": "High-Signal Communications Queue", "provenance": "Provenance And Source Of Truth",
}
ENTITY_TABLES = {
    "buildings": ("building", ["ID", "Building", "Units", "Floors", "Elevator", "Built", "Sources"]), "units": ("unit", ["ID", "Building", "Unit", "Location", "sqm", "Rooms", "MEA", "Sources"]),
    "owners": ("owner", ["ID", "Name", "Units", "Self-user", "Board", "Email", "Sources"]), "tenants": ("tenant", ["ID", "Name", "Unit", "Owner", "Start", "End", "Sources"]),
    "contractors": ("contractor", ["ID", "Company", "Trade", "Contact", "Email", "Phone", "Sources"]),
}
ENTITY_FIELDS = {
    "buildings": ("einheiten", "etagen", "fahrstuhl", "baujahr"), "units": ("haus_id", "einheit_nr", "lage", "wohnflaeche_qm", "zimmer", "miteigentumsanteil"), "owners": ("einheit_ids", "selbstnutzer", "beirat", "email"),
    "tenants": ("einheit_id", "eigentuemer_id", "mietbeginn"), "contractors": ("branche", "ansprechpartner", "email", "telefon"),
}
LATEST = {"payments": 30, "invoices": 30, "documents": 50, "issues": 80, "changes": 80, "risks": 100, "communications": 100}
SOURCES_SHOWN, ENTITIES_SHOWN, DECISIONS_SHOWN, QUOTE, CATEGORIES = 5, 6, 3, 180, 10
OPEN_KINDS = ("issue", "deadline", "obligation")
CHANGE_KINDS = ("status_change", "decision", "communication_event", "issue", "deadline", "obligation")
MONETARY_TYPES, PROTOCOL = ("mahnung", "hausgeld", "bka", "mieterhoehung"), "etv_protokoll"
HIGH_SIGNAL = "(?i)mangel|schaden|heizung|dach|aufzug|einspruch|sonderumlage|kaution|jahresabrechnung|beschluss|etv|mahnung|kündigung|kuendigung|wasser|reparatur|angebot"
UNKNOWN_GROSS, PENDING_GROSS = "unknown gross", "PDF text pending"
PROVENANCE = [
    "- Context.md is a materialized view, not the source of truth.", "- Source registry: contexts/LIE-001/source-registry.json", "- Entity index: contexts/LIE-001/entity-index.json", "- Fact index: contexts/LIE-001/fact-index.json",
    "- Entity links: workdir/entity-links/entity-links.jsonl", "- Observations: workdir/observations/observations.jsonl", "- Semantic observations: workdir/semantic/observations.jsonl",
    "- Latest change set: workdir/changes/latest-change-set.json", "- Entity context views: contexts/LIE-001/entities/*.md", "- Patch log: contexts/LIE-001/patch-log.jsonl",
]
# End of fixed values.

LINE = ["section_id", "part", "place", "line"]


def attr(name: str) -> Column:
    return F.coalesce(json_text(F.col("attributes"), name), F.lit(""))


def fact_date() -> Column:
    """A fact's date as text: event, due date, start of validity, else what its attributes or their row say."""
    told = F.coalesce("event_date", "due_date", "valid_from", json_text(F.col("attributes"), "date"))
    return F.coalesce(missing_if_blank(told), missing_if_blank(F.get_json_object("attributes", "$.row.datum")), F.lit(""))


def _newest(date: Column) -> list[Column]:
    """Latest first; facts of one date stand in the order of kind and subject."""
    return [F.desc(epoch_millis(date)), F.asc("kind"), F.asc("subject_id"), F.asc("fact_id")]


def latest(facts: DataFrame, date: Column, k: int) -> DataFrame:
    """The ``k`` latest facts with their ``rank``; only these are ranked."""
    kept = facts.withColumn("_shown_date", date).orderBy(*_newest(F.col("_shown_date"))).limit(k)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*_newest(F.col("_shown_date"))))).drop("_shown_date")


class Sections:
    """``facts`` with their ``sources``, ``entities`` and ``evidence`` (see ``facts.build_facts``), and the entity ``index``.

    ``sources`` may also be a function that gives the sources of some facts (fact_id, kind, subject_id).
    """

    def __init__(self, facts: DataFrame, sources: DataFrame | Callable[[DataFrame], DataFrame], entities: DataFrame, evidence: DataFrame, index: DataFrame, property_id: str):
        self.facts, self.sources, self.entities, self.evidence, self.index, self.property_id = facts, sources, entities, evidence, index, property_id
        self.spark = facts.sparkSession

    # -- parts of lines --------------------------------------------------------------------------------------------

    def referenced(self, facts: DataFrame) -> DataFrame:
        """``facts`` with ``ref``: the first sources of each."""
        # A fact of one source names it itself; the others, written so that few of them are looked up by a broadcast.
        several = cut(facts.where("source_count > 1").select("fact_id", "kind", "subject_id"))
        found = self.sources(several) if callable(self.sources) else self.sources.join(several.select("fact_id"), "fact_id", "left_semi")
        own = first_values(found, "fact_id", "source_id", SOURCES_SHOWN)
        named = F.when(F.col("source_count") > 1, F.col("_sources")).otherwise(F.array("first_source"))
        return facts.join(own.withColumnRenamed("values", "_sources"), "fact_id", "left").withColumn("ref", source_reference(named)).drop("_sources")

    def concerned(self, facts: DataFrame) -> DataFrame:
        """``facts`` with ``concerns``: the first entities of each."""
        own = first_values(self.entities.join(facts.select("fact_id"), "fact_id", "left_semi"), "fact_id", "entity_id", ENTITIES_SHOWN)
        return facts.join(own.withColumnRenamed("values", "_entities"), "fact_id", "left").withColumn("concerns", F.coalesce(F.array_join("_entities", ", "), F.lit(""))).drop("_entities")

    def quoted(self, facts: DataFrame) -> DataFrame:
        """``facts`` with ``quote``: the first quote of each, on one line."""
        own = self.evidence.where("evidence.quote <> ''").join(facts.select("fact_id"), "fact_id", "left_semi").groupBy("fact_id").agg(F.min_by("evidence.quote", "place").alias("q"))
        return facts.join(own, "fact_id", "left").withColumn("quote", F.coalesce(F.substring(squeeze(F.col("q")), 1, QUOTE), F.lit(""))).drop("q")

    def fixed(self, section: str, part: int, lines: list[str]) -> DataFrame:
        return self.spark.range(1).select(F.posexplode(F.array(*map(F.lit, lines))).alias("n", "line")).select(F.lit(section).alias("section_id"), F.lit(part).alias("part"), F.format_string("%04d", "n").alias("place"), "line")

    def told(self, section: str, part: int, one: DataFrame, *lines: Column) -> DataFrame:
        """Lines of a frame of one row."""
        return one.select(F.posexplode(F.array(*lines)).alias("n", "line")).select(F.lit(section).alias("section_id"), F.lit(part).alias("part"), F.format_string("%04d", "n").alias("place"), "line")

    def table(self, section: str, part: int, headers: list[str], rows: DataFrame, place: Column, *cells: Column) -> DataFrame:
        """Header and rows in the order of ``place`` (text), or a line that says that there are none."""
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))
        body = rows.select(F.lit(section).alias("section_id"), F.lit(part + 1).alias("part"), place.alias("place"), line.alias("line"))
        any_ = rows.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("there"))
        head = F.when(F.col("there"), F.array(F.lit(f"| {' | '.join(headers)} |"), F.lit(f"| {' | '.join('---' for _ in headers)} |"))).otherwise(F.array(F.lit(NO_ROWS)))
        top = any_.select(F.posexplode(head).alias("n", "line")).select(F.lit(section).alias("section_id"), F.lit(part).alias("part"), F.format_string("%04d", "n").alias("place"), "line")
        return top.unionByName(body)

    # -- sections --------------------------------------------------------------------------------------------------

    def by_subject(self) -> DataFrame:
        """(subject_id, fact_id, kind, source_count, first_source): of the facts of a subject the last in the order of kinds."""
        return self.facts.where("subject_id IS NOT NULL").groupBy("subject_id").agg(F.max_by(F.struct("fact_id", "kind", "source_count", "first_source"), F.struct("kind", "fact_id")).alias("f")).select("subject_id", "f.*")

    def of_type(self, kind: str) -> DataFrame:
        own = self.index.where(F.col("entity_type") == kind)
        facts = self.referenced(self.by_subject().join(own.select(F.col("entity_id").alias("subject_id")), "subject_id", "left_semi"))
        return own.join(facts.select(F.col("subject_id").alias("entity_id"), "ref"), "entity_id", "left").withColumn("ref", F.coalesce("ref", F.lit("")))

    def profile(self) -> DataFrame:
        f = lambda c: F.coalesce(F.col("fields")[c], F.lit(""))
        or_else = lambda c, other: F.coalesce(missing_if_blank(f(c)), F.lit(other))
        line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        address = F.concat_ws(", ", *[missing_if_blank(f(c)) for c in ("strasse", "plz", "ort")])
        one = self.of_type("property").where(F.col("entity_id") == self.property_id)
        return self.told(
            "property-profile", 0, one, line(f"- Property ID: {self.property_id}. Sources: ", F.col("ref")), line("- Name: ", F.coalesce(missing_if_blank(f("name")), "name")), line("- Address: ", address),
            line("- Built / renovated: ", or_else("baujahr", "unknown"), " / ", or_else("sanierung", "unknown")), line("- Manager: ", f("verwalter"), " (", f("verwalter_email"), ", ", f("verwalter_telefon"), ")"),
            line("- Operating account: ", f("weg_bankkonto_iban"), " ", f("weg_bankkonto_bank")), line("- Reserve account: ", f("ruecklage_iban")),
        )

    def entity_table(self, section: str) -> DataFrame:
        kind, headers = ENTITY_TABLES[section]
        f = lambda c: F.coalesce(F.col("fields")[c], F.lit(""))
        own = [f(c) for c in ENTITY_FIELDS[section]]
        if section == "buildings":
            own = [F.concat(F.lit("Haus "), f("hausnr")), *own]
        elif section != "units":
            own = [F.col("name"), *own]
        if section == "tenants":
            own.append(F.coalesce(missing_if_blank(f("mietende")), F.lit("active")))
        return self.table(section, 0, headers, self.of_type(kind), F.col("entity_id"), F.col("entity_id"), *own, F.col("ref"))

    def financials(self) -> DataFrame:
        section = "financials"
        payments = self.facts.where("kind = 'payment'").withColumns({"date": fact_date(), "amount": signed_payment(parse_number(attr("amount")), attr("type"))})
        category = F.coalesce(F.get_json_object("attributes", "$.row.kategorie"), F.get_json_object("attributes", "$.row.Buchungstext"), attr("type"))
        totals = payments.agg(
            F.count("*").cast("string").alias("n"), F.min(missing_if_blank(F.col("date"))).alias("first"), F.max(missing_if_blank(F.col("date"))).alias("last"),
            F.coalesce(F.sum(F.when(F.col("amount") >= 0, F.col("amount"))), F.lit(0)).alias("inflow"), F.coalesce(F.sum(F.when(F.col("amount") < 0, F.col("amount"))), F.lit(0)).alias("outflow"),
        )
        top = payments.groupBy(category.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(CATEGORIES)
        listed = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name", "n"))), lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("categories"))
        line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        head = self.told(
            section, 0, totals.join(F.broadcast(listed)), line("- Payment facts: ", F.col("n")), line("- Date range: ", F.coalesce("first", F.lit("unknown")), " to ", F.coalesce("last", F.lit("unknown"))),
            line("- Approx. positive inflow total: ", money_text(F.col("inflow"))), line("- Approx. negative outflow total: ", money_text(F.col("outflow"))), line("- Categories: ", F.col("categories")), F.lit(""), F.lit("### Recent Payments"), F.lit(""),
        )
        shown = self.referenced(latest(payments, F.col("date"), LATEST["payments"]))
        return head.unionByName(self.table(section, 1, ["TX", "Date", "Type", "Amount", "Counterparty", "Reference", "Sources"], shown, F.format_string("%04d", "rank"), F.col("subject_id"), F.col("date"), attr("type"), money_text(F.col("amount")), attr("counterparty"), attr("reference"), F.col("ref")))

    def invoices(self) -> DataFrame:
        section, headers = "invoices", ["Invoice", "Date", "Contractor", "Number", "Gross", "Decision", "Sources"]
        invoices = self.facts.where("kind = 'invoice'").withColumn("gross", attr("gross"))
        whole = (F.col("gross") != "") & (F.col("gross") != UNKNOWN_GROSS)
        counts = invoices.agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.count_if(F.col("decision") != "keep").alias("review"))
        line = lambda text, c: F.concat(F.lit(text), c.cast("string"))
        head = self.told(
            section, 0, counts, line("- Invoice facts: ", F.col("n")), line("- Amount available from structured index: ", F.col("whole")), line("- Metadata-only PDF invoices pending text extraction: ", F.col("n") - F.col("whole")),
            line("- Review/anomaly candidates: ", F.col("review")), F.lit("- Complete invoice ledger is in contexts/LIE-001/fact-index.json; Context.md shows review items and latest invoices only."), F.lit(""), F.lit("### Review Candidates"), F.lit(""),
        )
        cells = [F.col("subject_id"), attr("date"), attr("contractorId"), attr("invoiceNumber"), F.when(F.col("gross") == UNKNOWN_GROSS, PENDING_GROSS).otherwise(F.col("gross")), F.col("decision"), F.col("ref")]
        review = self.referenced(invoices.where("decision <> 'keep'"))
        place = F.concat_ws(":", F.format_string("%016d", F.lit(10**15) - epoch_millis(attr("date"))), "subject_id")
        shown = self.referenced(latest(invoices, attr("date"), LATEST["invoices"]))
        return (
            head.unionByName(self.table(section, 1, headers, review, place, *cells)).unionByName(self.fixed(section, 3, ["", "### Latest Invoices", ""])).unionByName(self.table(section, 4, headers, shown, F.format_string("%04d", "rank"), *cells))
        )

    def documents(self) -> DataFrame:
        section = "documents"
        documents = self.facts.where("kind = 'document'").withColumns({"type": attr("letterType"), "decided": json_list(F.col("attributes"), "decisions")})
        decided = documents.where((F.col("type") == PROTOCOL) & (F.size("decided") > 0))
        types = documents.groupBy(F.coalesce(missing_if_blank(F.col("type")), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
        listed = types.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name", "n"))), lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("types"))
        counts = documents.agg(F.count("*").alias("n"), F.count_if((F.col("type") == PROTOCOL) & (F.size("decided") > 0)).alias("decided")).join(F.broadcast(listed))
        line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        text = lambda c: c.cast("string")
        head = self.told(
            section, 0, counts, line("- Document metadata facts: ", text(F.col("n"))), line("- ETV protocols with extracted decisions: ", text(F.col("decided"))), line("- Types: ", F.col("types")),
            F.lit("- Amount is shown as n/a when the document type does not contain a direct monetary amount."),
            line("- Table below shows latest ", text(F.least("n", F.lit(LATEST["documents"]))), "; complete structured facts and extracted text are in fact-index.json and normalized PDF markdown."), F.lit(""), F.lit("### Extracted ETV Protocol Decisions"), F.lit(""),
        )
        place = F.concat_ws(":", F.format_string("%016d", F.lit(10**15) - epoch_millis(attr("date"))), "subject_id")
        first = self.table(section, 1, ["Letter", "Date", "Type", "Decisions", "Sources"], self.referenced(decided), place, F.col("subject_id"), attr("date"), F.col("type"), F.array_join(F.slice("decided", 1, DECISIONS_SHOWN), "; "), F.col("ref"))
        amount = F.when(F.col("type").isin(*MONETARY_TYPES), F.coalesce(missing_if_blank(attr("amount")), F.lit("needs_review"))).otherwise("n/a")
        shown = self.referenced(latest(documents, attr("date"), LATEST["documents"]))
        second = self.table(section, 4, ["Letter", "Date", "Type", "Subject", "Amount", "Sources"], shown, F.format_string("%04d", "rank"), F.col("subject_id"), attr("date"), F.col("type"), attr("subject"), amount, F.col("ref"))
        return head.unionByName(first).unionByName(self.fixed(section, 3, ["", "### Latest Documents", ""])).unionByName(second)

    def listed(self, section: str, chosen: DataFrame, k: int, counted: str, notes: list[str], headers: list[str], cells: list[Column]) -> DataFrame:
        """A section of a count, notes and one table of the latest facts."""
        shown = self.quoted(self.concerned(self.referenced(latest(chosen, fact_date(), k))))
        count = chosen.select("fact_id").limit(k).agg(F.count("*").alias("n"))
        head = self.told(section, 0, count, F.concat(F.lit(counted), F.col("n").cast("string")), *map(F.lit, [*notes, ""]))
        return head.unionByName(self.table(section, 1, headers, shown, F.format_string("%04d", "rank"), *cells))

    def open_issues(self) -> DataFrame:
        status = F.coalesce(missing_if_blank(attr("status")), "decision")
        chosen = self.facts.where(F.col("kind").isin(*OPEN_KINDS) & (status != "resolved"))
        cells = [F.col("fact_id"), F.col("kind"), attr("subtype"), fact_date(), F.coalesce("due_date", F.lit("")), status, F.coalesce(missing_if_blank(attr("priority")), F.lit("unknown")), F.col("concerns"), F.col("statement"), F.col("ref")]
        notes = ["- These facts come from scoped observations; ambiguous items stay needs_review instead of being silently promoted."]
        return self.listed("current-open-issues", chosen, LATEST["issues"], "- Open issue/deadline/obligation facts: ", notes, ["Fact", "Kind", "Subtype", "Date", "Due", "Status", "Priority", "Entities", "Summary", "Sources"], cells)

    def recent_changes(self) -> DataFrame:
        cells = [F.col("fact_id"), fact_date(), F.col("kind"), attr("subtype"), F.col("concerns"), F.col("statement"), F.col("ref")]
        return self.listed("recent-important-changes", self.facts.where(F.col("kind").isin(*CHANGE_KINDS)), LATEST["changes"], "- Recent semantic/change facts shown: ", [], ["Fact", "Date", "Kind", "Subtype", "Entities", "Summary", "Sources"], cells)

    def risks(self) -> DataFrame:
        chosen = self.facts.where((F.col("kind") == "risk") | ((F.col("decision") != "keep") & F.col("kind").isin("invoice", *SEMANTIC_KINDS)))
        priority = F.coalesce(F.nullif(missing_if_blank(attr("priority")), F.lit("unknown")), F.lit("n/a"))
        shown = lambda c: F.coalesce(missing_if_blank(c), F.lit("n/a"))
        cells = [F.col("fact_id"), F.col("kind"), shown(attr("subtype")), fact_date(), F.col("decision"), priority, F.col("concerns"), F.col("statement"), shown(F.col("quote")), F.col("ref")]
        notes = [
            "- Routine email metadata is intentionally excluded here; it remains in Communications Needing Review.",
            "- Evidence quotes are included when extracted from unstructured text; n/a means deterministic metadata did not include a body quote.",
        ]
        return self.listed("risks-needs-review", chosen, LATEST["risks"], "- Risk, semantic needs-review, or invoice anomaly facts: ", notes, ["Fact", "Kind", "Subtype", "Date", "Decision", "Priority", "Entities", "Summary", "Evidence", "Sources"], cells)

    def communications(self) -> DataFrame:
        section = "communications-review"
        every = self.facts.where("kind = 'communication'").withColumns({"range": F.from_json(F.get_json_object("attributes", "$.glimpse.dateRange"), "array<string>"), "subjects": F.from_json(F.get_json_object("attributes", "$.glimpse.preview.subjects"), "array<string>")})
        signal = F.col("statement").rlike(HIGH_SIGNAL) | F.col("attributes").rlike(HIGH_SIGNAL)
        last = F.coalesce(F.get("range", F.lit(1)), F.lit(""))
        shown = self.referenced(latest(every.where(signal), last, LATEST["communications"]))
        counts = every.agg(F.count("*").alias("n"), F.least(F.count_if(signal), F.lit(LATEST["communications"])).alias("shown"))
        head = self.told(
            section, 0, counts, F.concat(F.lit("- Communication metadata facts: "), F.col("n").cast("string")), F.concat(F.lit("- High-signal review candidates shown: "), F.col("shown").cast("string")),
            F.lit("- queued_for_body_review means the thread was linked from metadata and keyword triage, but its full body has not been promoted into durable semantic facts yet."),
            F.lit("- This is not an entity-link failure. Semantic body facts, when extracted, are promoted into Current Open Issues, Recent Important Changes, and Risks / Needs Review."), F.lit(""),
        )
        label = F.when(F.col("decision") == "needs_review", "queued_for_body_review").otherwise(F.col("decision"))
        cells = [F.coalesce("subject_id", "fact_id"), F.coalesce(F.array_join("range", " to "), F.lit("")), F.coalesce(F.array_join("subjects", "; "), "statement"), label, F.col("ref")]
        return head.unionByName(self.table(section, 1, ["Thread/Fact", "Date range", "Subject", "Triage", "Sources"], shown, F.format_string("%04d", "rank"), *cells))

    def provenance(self) -> DataFrame:
        counts = cut(self.facts.groupBy("kind").agg(F.count("*").cast("string").alias("n")))
        return self.fixed("provenance", 0, [*PROVENANCE, ""]).unionByName(self.table("provenance", 1, ["Fact kind", "Count"], counts, F.col("kind"), F.col("kind"), F.col("n")))

    def lines(self) -> DataFrame:
        """(section_id, part, place, line) of all sections."""
        parts = [self.profile(), *map(self.entity_table, ENTITY_TABLES), self.financials(), self.invoices(), self.documents(), self.open_issues(), self.recent_changes(), self.risks(), self.communications(), self.provenance()]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every.select(*LINE)

    def numbered(self, lines: DataFrame | None = None) -> DataFrame:
        """(section_id, line_no, line) of all sections, or of some ``lines``: a section of any size stays rows over many tasks.

        Lines are numbered from 1 within their section, by ranges of the order in which they stand.
        """
        order = F.create_map(*[x for n, s in enumerate(TITLES) for x in (F.lit(s), F.lit(n))])
        rows = (self.lines() if lines is None else lines).withColumn("_section", F.element_at(order, F.col("section_id")))
        placed = cut(numbered(rows, [F.col(c) for c in ("_section", "part", "place", "line")], "_at"))
        first = placed.groupBy("section_id").agg(F.min("_at").alias("_first"))
        return placed.join(F.broadcast(first), "section_id").select("section_id", (F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")

    def fact_ids(self) -> DataFrame:
        """(section_id, fact_id): the facts that each kind's section stands on."""
        from factloom.operators.changes import section_of

        own = self.facts.select(section_of(F.col("kind")).alias("section_id"), "fact_id")
        return own.unionByName(self.facts.select(F.lit("provenance").alias("section_id"), "fact_id")).distinct()

    def build(self) -> DataFrame:
        """(section_id, place, title, content, hash): each section's whole text, in the order in which they stand."""
        from factloom.operators.views import content_hash, trim_end

        order = F.create_map(*[x for n, s in enumerate(TITLES) for x in (F.lit(s), F.lit(n))])
        title = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
        body = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"])
        whole = self.lines().groupBy("section_id").agg(body.alias("body"))
        named = whole.select("section_id", F.element_at(order, F.col("section_id")).alias("place"), F.element_at(title, F.col("section_id")).alias("title"), "body")
        text = named.select("section_id", "place", "title", trim_end(F.concat(F.lit("## "), "title", F.lit("\n\n"), F.array_join("body", "\n"))).alias("content"))
        return text.withColumn("hash", content_hash(F.col("content")))

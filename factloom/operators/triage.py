"""Which work items deserve a closer look: word categories, selection, decisions, and an extractor that can be supplied."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import fold_triage, json_id, sorted_distinct
from factloom.operators.rounds import cut, once

# Weight and terms of each category, limits of texts, of selections and of quotes, kinds and states of
# extracted facts, reasons of decisions.
KEYWORDS = {
    "maintenance": (5, ["mangel", "schaden", "defekt", "reparatur", "instandsetzung", "wasserschaden", "wasser", "feuchtigkeit", "schimmel", "heizung", "warmwasser", "strom", "tuer", "tür", "fenster", "dach", "keller", "aufzug", "treppenhaus", "sprechanlage", "schloss", "rohr", "leitung", "verstopfung"]),
    "dispute": (7, ["beschwerde", "einspruch", "widerspruch", "streit", "minderung", "mietminderung", "mahnung", "verzug", "rueckstand", "rückstand", "anwalt", "rechtsanwalt", "gericht", "fristsetzung", "kuendigung", "kündigung", "abmahnung", "eskalation", "nicht einverstanden"]),
    "finance": (4, ["rechnung", "zahlung", "bezahlt", "offen", "faellig", "fällig", "ueberweisung", "überweisung", "rueckerstattung", "rückerstattung", "gutschrift", "kaution", "miete", "hausgeld", "wirtschaftsplan", "abrechnung", "jahresabrechnung", "betriebskosten", "nebenkosten", "sonderumlage", "saldo", "iban"]),
    "governance": (4, ["etv", "eigentuemerversammlung", "eigentümerversammlung", "versammlung", "beschluss", "beschlussfassung", "protokoll", "tagesordnung", "top", "beirat", "verwaltung", "vollmacht", "umlaufbeschluss", "mehrheit", "abstimmung"]),
    "contractor": (3, ["angebot", "kostenvoranschlag", "auftrag", "beauftragt", "termin", "besichtigung", "vor ort", "monteur", "handwerker", "dienstleister", "firma", "ausfuehrung", "ausführung", "lieferung", "montage", "rueckmeldung", "rückmeldung"]),
    "deadline": (6, ["frist", "bis zum", "spaetestens", "spätestens", "deadline", "erinnerung", "rueckmeldung bis", "rückmeldung bis", "heute", "morgen", "kommende woche", "naechste woche", "nächste woche"]),
    "access": (3, ["zugang", "schluessel", "schlüssel", "wohnung betreten", "terminvereinbarung", "anwesend", "nicht erreichbar", "mieter", "eigentuemer", "eigentümer"]),
    "risk": (8, ["gefahr", "sicherheit", "brand", "brandschutz", "notfall", "evakuierung", "versicherung", "haftung", "polizei", "gesundheit", "unbewohnbar", "einsturz", "stromausfall"]),
    "noise": (-4, ["newsletter", "werbung", "automatische antwort", "abwesenheit", "empfangsbestaetigung", "empfangsbestätigung", "zur kenntnis", "fyi"]),
}
NOISE, DEEP_LIMIT, RECENT_WEIGHT, MOST_SIZE = "noise", 25, 8, 8
SOURCE_TEXT, ITEM_TEXT, ITEM_SOURCES, QUOTE = 1_600, 12_000, 16, 500
FACT_KINDS = ("issue", "decision", "obligation", "deadline", "risk", "status_change", "communication_event")
REASONS = {
    "other": "Non-email work item is handled by deterministic extractors in this pass.", "plain": "Email thread has no high-signal property-management terms after deterministic triage.",
    "deferred": "High-signal thread deferred after bounded selection limit {}.", "unread": "High-signal thread selected, but no extractor is available.",
}
EXTRACTED = "LLM semantic extraction from high-signal email thread, bounded by deterministic entity candidates."
# End of fixed values.

#: Schema of an extractor's answer.
ANSWER = "struct<facts:array<struct<kind:string,subtype:string,summary:string,status:string,priority:string,eventDate:string,dueDate:string,primaryEntityId:string,entities:array<string>,evidence:array<struct<sourceId:string,quote:string>>,decision:string>>>"


def category_hits(text: Column, words: dict[str, tuple[int, list[str]]]) -> Column:
    """The categories of which any word stands in ``text``, a column of folded texts."""
    found = [F.when(reduce(or_, [F.contains(text, fold_triage(F.lit(t))) for t in terms]), F.lit(name)) for name, (_, terms) in words.items() if terms]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def score(items: DataFrame, words: dict[str, tuple[int, list[str]]] = KEYWORDS, text_col: str = "text") -> DataFrame:
    """``items`` with categories, score, actionable: each category counts once, by any of its terms."""
    hits = category_hits(F.col("_folded"), words)
    value = F.create_map(*[F.lit(x) for name, (weight, _) in words.items() for x in (name, weight)])
    total = F.aggregate(F.col("categories"), F.lit(0), lambda a, c: a + F.coalesce(F.element_at(value, c), F.lit(0)))
    # A text is folded once, not for each word; the categories are worked out once.
    scored = once(once(items, {"_folded": fold_triage(F.coalesce(F.col(text_col), F.lit("")))}), {"categories": hits}).drop("_folded").withColumn("score", total)
    return scored.withColumn("actionable", (F.size(F.filter("categories", lambda c: c != NOISE)) > 0) & (F.col("score") > 0))


def priority(score_: Column, size: Column, recent: Column) -> Column:
    return score_ + F.when(recent, RECENT_WEIGHT).otherwise(0) + F.least(size, F.lit(MOST_SIZE))


def item_texts(items: DataFrame, assigned: DataFrame, texts: DataFrame) -> DataFrame:
    """(work_item_id, text): summary and preview, then the start of each of the first ITEM_SOURCES sources, cut to ITEM_TEXT.

    ``items``: work_item_id, glimpse; ``assigned``: work_item_id, source_id; ``texts``: source_id, text.  Only so many
    sources of an item are ever gathered.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("work_item_id").orderBy("source_id"))
    first = assigned.select("work_item_id", "source_id").withColumn("rank", rank).where(F.col("rank") <= ITEM_SOURCES)
    part = F.concat(F.lit("### "), "source_id", F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, SOURCE_TEXT))
    read = first.join(texts.select("source_id", "text"), "source_id").select("work_item_id", "rank", part.alias("part"))
    body = read.groupBy("work_item_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n"), 1, ITEM_TEXT).alias("body"))
    head = items.select("work_item_id", F.concat_ws("\n", "glimpse.summary", F.to_json("glimpse.preview")).alias("head"))
    return head.join(body, "work_item_id", "left").select("work_item_id", F.concat_ws("\n", "head", F.coalesce("body", F.lit(""))).alias("text"))


def select(items: DataFrame, limit: int = DEEP_LIMIT, eligible: Column | None = None) -> DataFrame:
    """(id, priority, size, actionable, categories, decision) of ``items``.

    The ``limit`` best actionable items are examined, other actionable ones deferred; the rest are ignored as noise or
    only listed, like those that aren't ``eligible``.  Scores are written first, without texts, so that texts are
    read once; only candidates are ranked, and by a limited sort, so no window spans all rows.
    """
    able = F.col("actionable") if eligible is None else F.col("actionable") & eligible
    slim = cut(items.select("id", "priority", "size", "actionable", "categories", able.alias("able"), (F.lit(True) if eligible is None else eligible).alias("eligible")))
    chosen = slim.where("able").orderBy(F.desc("priority"), F.desc("size"), "id").limit(max(limit, 0)).select("id", F.lit(True).alias("chosen"))
    rest = F.when(~F.col("eligible"), "metadata_only").when(F.array_contains("categories", NOISE), "ignore").otherwise("metadata_only")
    decision = F.when(F.col("chosen"), "deep_extract").when(F.col("able"), "deferred").otherwise(rest)
    return slim.join(F.broadcast(chosen), "id", "left").withColumn("decision", decision).drop("chosen", "able", "eligible")


def item_hash(items: DataFrame, links: DataFrame, version: int, model: str, limit: int) -> DataFrame:
    """(work_item_id, input_hash): what a decision depends on: the item, its links, the model and the limit.

    ``links``: work_item_id, entity_id, match_type, inherited_from; they count whatever their order.
    """
    linked = links.groupBy("work_item_id").agg(F.sum(F.xxhash64("entity_id", "match_type", "inherited_from").cast("decimal(38,0)")).cast("string").alias("links"))
    text = F.concat_ws("|", F.lit(str(version)), F.lit(str(limit)), F.lit(model), "work_item_id", "input_hash", F.coalesce("links", F.lit("")))
    return items.join(linked, "work_item_id", "left").select("work_item_id", F.sha2(text, 256).alias("input_hash"))


def reused(hashed: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(earlier decisions that still hold, items to be decided); a decision ``error`` never holds."""
    held = decisions.where("decision <> 'error'")
    key = ["work_item_id", "input_hash"]
    return held.join(hashed.select(*key), key, "left_semi"), hashed.join(held.select(*key), key, "left_anti")


def decide(items: DataFrame, limit: int = DEEP_LIMIT, extractor: bool = False) -> DataFrame:
    """(work_item_id, input_hash, categories, decision, reason, decision_id) of work items.

    ``items``: work_item_id, input_hash, kind, sources, recent, text.  Only mail threads are examined.  Chosen ones need
    review unless there is an ``extractor`` for them, in which case their decision is deep_extract.
    """
    scored = score(items.withColumnRenamed("work_item_id", "id"))
    ranked = scored.withColumn("size", F.col("sources")).withColumn("priority", priority(F.col("score"), F.col("sources"), F.col("recent")))
    is_mail = F.col("kind") == "email_thread"
    chosen = select(ranked, limit, is_mail).select(F.col("id").alias("work_item_id"), "categories", "decision")
    told = items.select("work_item_id", "input_hash", "kind").join(chosen, "work_item_id")
    last = told.withColumn("decision", F.when((F.col("decision") == "deep_extract") & ~F.lit(extractor), "needs_review").otherwise(F.col("decision")))
    reason = (
        F.when(~is_mail, REASONS["other"]).when(F.col("decision") == "needs_review", REASONS["unread"]).when(F.col("decision") == "deferred", REASONS["deferred"].format(limit)).when(F.col("decision") == "deep_extract", EXTRACTED).otherwise(REASONS["plain"])
    )
    none = F.array().cast("array<string>")
    named = last.select("work_item_id", "input_hash", F.when(is_mail, F.array_sort("categories")).otherwise(none).alias("categories"), "decision", reason.alias("reason"))
    return named.withColumn("decision_id", json_id("SEMDEC", workItemId=F.col("work_item_id"), inputHash=F.col("input_hash"), decision=F.col("decision"), reason=F.col("reason")))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """One row: work items decided, and how many by each decision."""
    return decisions.agg(F.count("*").alias("decisions"), *[F.count_if(F.col("decision") == d).alias(d) for d in ("deep_extract", "needs_review", "deferred", "ignore", "metadata_only", "error")])


def balanced_object(text: str | None) -> str | None:
    """The first balanced JSON object of a model's answer, without a code fence around it."""
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif quoted:
            quoted, skip = c != '"', c == "\\"
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            depth, start = depth + 1, i if not depth else start
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def extract(items: DataFrame, extractor: Callable[[str], str] | None) -> DataFrame:
    """(id, answer, decision) of chosen items (id, text): without an extractor all need review.

    An answer that isn't JSON, or an extractor that fails, gives the decision ``error``.
    """
    if extractor is None:
        return items.select("id", F.lit(None).cast("string").alias("answer"), F.lit("needs_review").alias("decision"))

    def run(batches: Iterable):
        import json

        for pdf in batches:
            answers, decisions = [], []
            for text in pdf["text"]:
                try:
                    found = balanced_object(extractor(text))
                    json.loads(found)
                    answers.append(found)
                    decisions.append("extracted")
                except Exception:  # noqa: BLE001  the extractor is foreign code
                    answers.append(None)
                    decisions.append("error")
            yield pdf.assign(answer=answers, decision=decisions)[["id", "answer", "decision"]]

    return items.select("id", "text").mapInPandas(run, f"id {items.schema['id'].dataType.simpleString()}, answer string, decision string")


def supported(answers: DataFrame, property_id: str) -> DataFrame:
    """Observations of an extractor's answers (work_item_id, input_hash, answer, source_ids, allowed).

    Facts of an unknown kind, ignored ones and those that cite no source of their item with a quote are dropped.
    Entities are cut to the ``allowed`` candidates and the property, which is always among them.
    """
    fact = answers.select("work_item_id", "input_hash", "source_ids", F.array_union("allowed", F.array(F.lit(property_id))).alias("allowed"), F.explode(F.from_json("answer", ANSWER)["facts"]).alias("f"))
    quoted = F.transform(F.filter("f.evidence", lambda e: F.array_contains("source_ids", e["sourceId"]) & (F.trim(e["quote"]) != "")), lambda e: F.struct(e["sourceId"].alias("sourceId"), F.substring(F.trim(e["quote"]), 1, QUOTE).alias("quote")))
    named = F.array_union(F.coalesce("f.entities", F.array().cast("array<string>")), F.array(F.coalesce("f.primaryEntityId", F.lit(property_id)), F.lit(property_id)))
    decision = F.coalesce("f.decision", F.lit("needs_review"))
    told = fact.select("work_item_id", "input_hash", "source_ids", "f", quoted.alias("evidence"), sorted_distinct(F.array_intersect(named, "allowed")).alias("entities"), decision.alias("decision"))
    kept = told.where((F.size("evidence") > 0) & (F.col("decision") != "ignore") & F.col("f.kind").isin(*FACT_KINDS))
    primary = F.when(F.array_contains("entities", F.col("f.primaryEntityId")), F.col("f.primaryEntityId")).otherwise(F.get("entities", F.lit(0)))
    subject = json_id("SEMFACT", kind=F.col("f.kind"), subtype=F.col("f.subtype"), summary=F.col("f.summary"), entities=F.col("entities"), sourceIds=F.col("source_ids"))
    attributes = F.struct(
        subject.alias("subjectId"), F.col("f.subtype").alias("subtype"), F.coalesce("f.status", F.lit("unknown")).alias("status"), F.coalesce("f.priority", F.lit("unknown")).alias("priority"), F.col("f.eventDate").alias("eventDate"),
        F.col("f.dueDate").alias("dueDate"), primary.alias("primaryEntityId"), F.col("entities").alias("entities"),
    )
    made = kept.withColumn("attributes", attributes)
    identity = json_id("SEMOBS", inputHash=F.col("input_hash"), kind=F.col("f.kind"), statement=F.col("f.summary"), sourceIds=F.col("source_ids"), attributes=F.col("attributes"))
    return made.select(
        identity.alias("observation_id"), "work_item_id", "input_hash", F.col("f.kind").alias("kind"), F.col("f.summary").alias("statement"), F.col("entities").alias("mentions"), "evidence", "decision", F.lit(EXTRACTED).alias("reason"),
        F.lit("semantic_extractor").alias("processor"), F.to_json("attributes").alias("attributes"), F.explode(F.array_distinct(F.transform("evidence", lambda e: e["sourceId"]))).alias("source_id"),
    )

"""Work items: threads, invoice and letter groups, daily drops, with their glimpses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import naming, numbers
from factloom.operators.facts import first_values
from factloom.operators.rounds import cut
from factloom.functions.text import file_stem, message_id, missing_if_blank, month_of, squeeze, subject_key, trim

# Reason and processor of each kind of work item, and the keys of those that hold many sources.
KINDS = {
    "master_data_bundle": ("Canonical master data and base index CSVs establish schema alignment and entity identities.", "structured_extractor"),
    "bank_group": ("Historical bank CSV/XML files are processed together for transaction reconciliation.", "invoice_bank_reconciler"),
    "email_thread": ("Email conversation grouped by Message-ID/In-Reply-To/References, with subject/contact/month fallback.", "email_thread_extractor"),
    "invoice_group": ("Invoice grouped by invoice ID and contractor ID from filename/index metadata.", "invoice_bank_reconciler"),
    "letter_group": ("Letters grouped by month and letter type from deterministic filename metadata.", "pdf_letter_extractor"),
    "incremental_day": ("Incremental daily drop is processed atomically so downstream patches can be scoped to the changed day.", "structured_extractor"),
}
BUNDLE_KEYS = {"master_data_bundle": "base-master-data-and-indexes", "bank_group": "base-bank-ledger"}
#: How many values of each field a glimpse shows.
SHOWN = {"entity_hints": 12, "subjects": 6, "participants": 8, "invoice_ids": 4, "contractor_ids": 4, "file_names": 8, "letter_types": 6, "letter_ids": 6, "formats": 4}
#: The fields that each kind shows, and its labels.
PREVIEW = {
    "email_thread": ("subjects", "participants"), "invoice_group": ("invoice_ids", "contractor_ids", "file_names"), "letter_group": ("letter_types", "letter_ids", "file_names"),
    "bank_group": ("formats", "file_names"), "incremental_day": ("incremental_day", "file_names"), "master_data_bundle": ("file_names",),
}
LABELS = {"email_thread": ("email", "thread"), "invoice_group": ("invoice", "pdf-metadata"), "letter_group": ("letter", "pdf-metadata"), "bank_group": ("bank", "ledger", "reconciliation"), "incremental_day": ("incremental",), "master_data_bundle": ("master-data", "identity", "indexes")}
# End of fixed values.

#: Rounds after which a chain of answers must be resolved: each round doubles the steps taken.
ROUNDS = 40


def work_item_id(kind: str | Column, key: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.upper(F.concat(F.lit("WI-"), file_stem(kind), F.lit("-"), file_stem(key)))


def group_items(rows: DataFrame, kind: str, keys: list[str], id_col: str) -> DataFrame:
    """(work_item_id, keys, source_count, first_source, last_source) of rows grouped by ``keys``; members stay rows."""
    key = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    one = F.col(id_col).cast("string")
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("source_count"), F.min(one).alias("first_source"), F.max(one).alias("last_source"))
    return grouped.withColumn("work_item_id", work_item_id(kind, key))


def declared(prefix: str) -> Column:
    return F.get(F.filter("declared_ids", lambda x: x.startswith(prefix)), F.lit(0))


def mail_keys(sources: DataFrame) -> DataFrame:
    """(source_id, message_id, references, fallback) of mail sources with their ``meta``."""
    head = F.coalesce("meta.headers", F.create_map().cast("map<string,string>"))
    tokens = F.filter(F.flatten(F.array(*[F.split(F.coalesce(head[h], F.lit("")), r"\s+") for h in ("in-reply-to", "references")])), lambda x: x != "")
    contact = F.lower(squeeze(F.coalesce(head["from"], head["to"], F.lit("unknown-contact"))))
    subject = F.coalesce(subject_key(F.coalesce(head["subject"], F.lit(""))), F.lit("no-subject"))
    return sources.select(
        "source_id", message_id(head["message-id"]).alias("message_id"), F.filter(F.transform(tokens, message_id), lambda x: x.isNotNull()).alias("references"),
        F.concat_ws(":", month_of(F.col("source_date"), F.col("path")), subject, contact).alias("fallback"),
    )


def members(sources: DataFrame) -> DataFrame:
    """(kind, group_key, source_id): the work item that each eligible source belongs to.

    ``sources``: source_id, kind, path, declared_ids, source_date, day, meta.  Sources of a daily drop stay together;
    of the others, mails follow their references, invoices go by contractor and invoice, letters by month and type,
    and master data with indexes and bank files form a bundle each.  Other base sources have no work item.
    """
    base, drop = sources.where("day IS NULL"), sources.where("day IS NOT NULL")
    bundled = F.when(F.col("kind").isin("master_data", "index_csv"), "master_data_bundle").when(F.col("kind").isin("bank_csv", "bank_xml"), "bank_group")
    keys = F.element_at(F.create_map(*[F.lit(x) for pair in BUNDLE_KEYS.items() for x in pair]), F.col("item"))
    bundles = base.withColumn("item", bundled).where("item IS NOT NULL").select(F.col("item").alias("kind"), keys.alias("group_key"), "source_id")
    mails = threads(mail_keys(base.where("kind = 'email'"))).select(F.lit("email_thread").alias("kind"), F.col("thread_key").alias("group_key"), F.col("member").alias("source_id"))
    invoice = F.concat_ws(":", F.coalesce(declared("DL-"), F.lit("unknown-contractor")), F.coalesce(declared("INV-"), "source_id"))
    invoices = base.where("kind = 'invoice_pdf'").select(F.lit("invoice_group").alias("kind"), invoice.alias("group_key"), "source_id")
    stem = F.regexp_replace(naming.file_name(F.col("path")), r"\.[^.]+$", "")
    letter_type = F.coalesce(missing_if_blank(F.regexp_replace(F.regexp_replace(stem, r"^\d{8}_", ""), r"_LTR-\d+$", "")), F.lit("unknown-letter"))
    letters = base.where("kind = 'letter_pdf'").select(F.lit("letter_group").alias("kind"), F.concat_ws(":", month_of(F.col("source_date"), F.col("path")), letter_type).alias("group_key"), "source_id")
    days = drop.select(F.lit("incremental_day").alias("kind"), F.col("day").alias("group_key"), "source_id")
    return bundles.unionByName(mails).unionByName(invoices).unionByName(letters).unionByName(days)


def shown_values(rows: DataFrame) -> DataFrame:
    """(kind, group_key, field, values): the first values of each field of a work item, in order and each once.

    A row of ``rows`` is a member with its source's columns.  Only SHOWN values of a field are ever gathered.
    """
    m = lambda f: F.col(f"meta.{f}")
    value = {
        "entity_hints": F.col("declared_ids"), "subjects": F.array(m("headers")["subject"]), "participants": F.array(m("headers")["from"], m("headers")["to"]), "invoice_ids": F.array(m("invoice_id")),
        "contractor_ids": F.array(m("contractor_id")), "file_names": F.array(naming.file_name(F.col("path"))), "letter_types": F.array(m("letter_type")), "letter_ids": F.array(m("letter_id")), "formats": F.array(m("format")),
    }
    every = rows.select("kind", "group_key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("values")) for f, v in value.items()])).alias("x"))
    one = every.select("kind", "group_key", "x.field", F.explode("x.values").alias("value")).withColumn("value", trim(F.col("value"))).where("value <> ''").distinct()
    rank = F.row_number().over(Window.partitionBy("kind", "group_key", "field").orderBy("value"))
    most = F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), F.col("field"))
    kept = one.withColumn("rank", rank).where(F.col("rank") <= max(SHOWN.values())).where(F.col("rank") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    return kept.groupBy("kind", "group_key", "field").agg(listed.alias("values"))


def work_items(assigned: DataFrame, sources: DataFrame) -> DataFrame:
    """(work_item_id, kind, group_key, day, reason, processor, status, glimpse, input_hash) of each work item.

    ``assigned``: ``members`` of ``sources``.  glimpse is a struct of counts, dates, labels, metrics and previewed
    values as its kind shows them; input_hash changes with the members and with the glimpse.
    """
    rows = assigned.join(sources.drop("kind").join(sources.select("source_id", F.col("kind").alias("source_kind")), "source_id"), "source_id")
    m = lambda f: F.col(f"meta.{f}")
    dates = F.array("source_date", m("date"), numbers.utc_day(m("headers")["date"]))
    kinds = rows.groupBy("kind", "group_key", "source_kind").agg(F.count("*").alias("n")).groupBy("kind", "group_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_kind", "n")))).alias("source_kinds"))
    whole = rows.groupBy("kind", "group_key").agg(
        F.count("*").alias("sources"), F.sum(F.greatest(F.size("normalized_paths"), F.lit(0))).alias("artifacts"), F.min(F.array_min(dates)).alias("first_date"), F.max(F.array_max(dates)).alias("last_date"),
        F.coalesce(F.sum(m("row_count")), F.lit(0)).alias("rows"), F.count_if(m("duplicate") | m("fake")).alias("flagged"), F.min_by(month_of(F.col("source_date"), F.col("path")), "source_id").alias("month"), F.max("day").alias("day"),
        F.sum(F.xxhash64("source_id", "normalized_sha256").cast("decimal(38,0)")).cast("string").alias("digest"),
    )
    values = shown_values(rows).groupBy("kind", "group_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("values"))
    one = whole.join(kinds, ["kind", "group_key"]).join(values, ["kind", "group_key"], "left").withColumn("day", F.when(F.col("kind") == "incremental_day", F.col("day")))
    kind, n = F.col("kind"), F.col("sources")
    told = {k: F.coalesce(F.col("values")[k], F.array().cast("array<string>")) for k in SHOWN}
    first = lambda field, other: F.coalesce(F.get(told[field], F.lit(0)), F.lit(other))
    number, many = n.cast("string"), lambda c: F.when(c == 1, "").otherwise("s")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    summary = (
        F.when(kind == "email_thread", text(number, " email message", many(n), " grouped as a thread about ", first("subjects", "an unknown subject"), "."))
        .when(kind == "invoice_group", text(number, " invoice source", many(n), " for ", first("contractor_ids", "unknown contractor"), "."))
        .when(kind == "letter_group", text(number, " letter source", many(n), " grouped by ", first("letter_types", "letter type"), "."))
        .when(kind == "bank_group", text(number, " bank source", many(n), " with ", F.col("rows").cast("string"), " parsed CSV row", many(F.col("rows")), "."))
        .when(kind == "incremental_day", text(F.coalesce("day", "group_key"), " daily drop with ", number, " new source", many(n), "."))
        .otherwise("Canonical master data plus base index files for property identity, entity alignment, and starting ledger/document indexes.")
    )
    last_label = F.when(kind == "email_thread", F.array("month")).when(kind == "incremental_day", F.array(F.coalesce("day", "group_key"))).otherwise(F.array().cast("array<string>"))
    per_kind = lambda f: F.element_at(F.create_map(*[x for k in KINDS for x in (F.lit(k), f(k))]), kind)
    labels = F.concat(per_kind(lambda k: F.array(*map(F.lit, LABELS[k]))), last_label)
    metric = {
        "email_thread": {"messageCount": n}, "invoice_group": {"invoiceSourceCount": n, "flaggedFilenameCount": F.col("flagged")}, "letter_group": {"letterSourceCount": n},
        "bank_group": {"parsedRowCount": F.col("rows"), "bankSourceCount": n}, "incremental_day": {"newSourceCount": n, "parsedRowCount": F.col("rows")}, "master_data_bundle": {"parsedRowCount": F.col("rows"), "sourceFileCount": n},
    }
    metrics = per_kind(lambda k: F.create_map(*[x for name, v in metric[k].items() for x in (F.lit(name), v.cast("long"))]))
    preview = per_kind(lambda k: F.create_map(*[x for f in PREVIEW[k] for x in (F.lit(f), F.array("day") if f == "incremental_day" else told[f])]))
    glimpse = F.struct(
        n.alias("sourceCount"), F.col("artifacts").alias("normalizedArtifactCount"), F.col("source_kinds").alias("sourceKinds"), F.when(F.col("first_date").isNotNull(), F.array("first_date", "last_date")).alias("dateRange"),
        told["entity_hints"].alias("entityHints"), summary.alias("summary"), labels.alias("labels"), metrics.alias("metrics"), preview.alias("preview"),
    )
    item = one.select(work_item_id(kind, F.col("group_key")).alias("work_item_id"), "kind", "group_key", "day", per_kind(lambda k: F.lit(KINDS[k][0])).alias("reason"), per_kind(lambda k: F.lit(KINDS[k][1])).alias("processor"), F.lit("pending").alias("status"), glimpse.alias("glimpse"), "digest")
    return item.withColumn("input_hash", F.sha2(F.concat_ws("|", "work_item_id", "digest", F.to_json("glimpse")), 256)).drop("digest")


def parent_of(messages: DataFrame) -> DataFrame:
    """(source_id, parent_id): each message's first reference to an earlier known message.

    ``messages``: source_id, message_id, references (in the order in which they are tried).  A message id that
    several messages carry means the latest of them before the one that refers to it.
    """
    asked = messages.select("source_id", F.posexplode("references").alias("place", "message_id"))
    known = messages.where("message_id IS NOT NULL").select(F.col("source_id").alias("parent_id"), "message_id")
    found = asked.join(known, "message_id").where("parent_id < source_id")
    best = F.max_by("parent_id", F.struct(-F.col("place"), "parent_id"))
    return found.groupBy("source_id").agg(best.alias("parent_id"))


def thread_roots(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root) over a forest of (node, parent): every round doubles the steps, so few rounds are needed.

    Nodes whose parent is null are their own roots.  Rounds are cut by a checkpoint where there is a folder for it.
    """
    at = links.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("up"))
    for _ in range(ROUNDS):
        over = at.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = cut(at.join(over, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.coalesce("next", "up") != F.col("up")).alias("moved")))
        again = moved.where("moved").limit(1).count()
        at = moved.select("node", "up")
        if not again:
            break
    return at.select("node", F.col("up").alias("root"))


def threads(messages: DataFrame) -> DataFrame:
    """(thread_key, member): each message under its root's fallback key of month, subject and contact."""
    parents = parent_of(messages)
    linked = messages.join(parents, "source_id", "left").select("source_id", "parent_id", "fallback")
    roots = thread_roots(linked, "source_id", "parent_id")
    keyed = roots.join(messages.select(F.col("source_id").alias("root"), "fallback"), "root")
    return keyed.select(F.col("fallback").alias("thread_key"), F.col("node").alias("member"))


def glimpse(rows: DataFrame, key: str, date: str, kind: str, hint: str, most: int = 12) -> DataFrame:
    """Per group: counts, first and last date, kinds with their counts, and the first ``most`` distinct hints, which alone are gathered."""
    kinds = rows.groupBy(key, kind).agg(F.count("*").alias("n")).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "n"))), lambda x: F.concat_ws("=", x["k"], x["n"].cast("string"))), ",").alias("kinds")
    )
    whole = rows.groupBy(key).agg(F.count("*").alias("source_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    one = rows.select(key, trim(F.col(hint)).alias("hint")).where("hint <> ''").distinct()
    hints = first_values(one, key, "hint", most).select(key, F.array_join("values", ",").alias("hints"))
    return whole.join(kinds, key).join(hints, key, "left").withColumn("hints", F.coalesce("hints", F.lit("")))


def first_and_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count("*").alias("rows"))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def outcomes(items: DataFrame, observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(work_item_id, status) of work items: ``error`` if its decision is one, ``ignored`` or ``processed`` by what it led to, else ``queued``.

    ``observations`` and ``decisions``: rows with work_item_id, the latter with ``decision``.
    """
    seen = observations.select("work_item_id").distinct().withColumn("_seen", F.lit(True))
    decided = decisions.groupBy("work_item_id").agg(F.max(F.col("decision") == "error").alias("_error"), F.max(F.col("decision") == "ignore").alias("_ignored"))
    told = items.select("work_item_id").join(seen, "work_item_id", "left").join(decided, "work_item_id", "left")
    status = F.when(F.col("_error"), "error").when(F.col("_seen"), "processed").when(F.col("_ignored"), "ignored").when(F.col("_error").isNotNull(), "processed").otherwise("queued")
    return told.select("work_item_id", status.alias("status"))

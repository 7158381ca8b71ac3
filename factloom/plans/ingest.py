"""A whole run: scan, registry, normal forms, entities, work items, links, observations, facts, changes, views, coverage.

Each step's rows are written below ``store/runs/<number>`` and read again by the next ones, so a lost executor repeats
one step at most.  The next run finds what it may reuse in the folder of the last one, which ``store/log`` names.

What grows with all that was ever ingested is kept in tables of versions below ``store/tables``, to which a run adds
what it changes: texts and rows of sources normalized now, found aliases, observations of work items read now, and the
facts of subjects that new, withdrawn or otherwise described observations touch.  Aliases are looked for in new texts,
and in old ones only if they are new themselves.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import fold_search, mentions
from factloom.operators import changes, entities, extract, facts, linking, normalize, registry, triage, views, workqueue
from factloom.operators.sections import Sections
from factloom.sources.files import latest_day, read_files, read_table, write_lines
from factloom.sources.leases import Lease, local_path
from factloom.sources.versions import Delta, Versions, written

# The property, versions that results are bound to, the day that stands for all drops.
PROPERTY_ID, SEMANTIC_VERSION, ALL_DAYS = "LIE-001", 1, "day-99"
# End of fixed values.

LOG = "run long, at string, through string, folder string, token string"
EVENTS = "place int, stage string, level string, message string, rows map<string,long>"
HITS, NAMED = "source_id string, folded string", "source_id string, entity_id string"
OBSERVED = f"observation_id string, work_item_id string, input_hash string, source_id string, kind string, statement string, mentions array<string>, evidence array<{extract.EVIDENCE}>, decision string, reason string, processor string, attributes string"
#: What the reduction groups observations by, kept with them.
SUBJECT = "fact_kind string, subject_id string"
ONE_AT_A_TIME = threading.Lock()


@dataclass
class Run:
    """The tables of a run by name, its events and counts; ``rows``: how many rows it wrote to each table."""

    folder: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    events: list[tuple[str, str, str]] = field(default_factory=list)
    counts: dict[str, int | str | None] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def through_day(spark: SparkSession, root: str, mode: str | None) -> tuple[str | None, bool]:
    """(last day of drops, base only) of a mode: None, ``all-incremental``, ``latest-incremental`` or a day."""
    if mode is None:
        return None, True
    if mode == "all-incremental":
        return ALL_DAYS, False
    if mode == "latest-incremental":
        if (day := latest_day(read_files(spark, root)).first()["day"]) is None:
            raise ValueError("no daily drops found")
        return day, False
    return mode, False


def ingest(
    spark: SparkSession, root: str, store: str, now: str, mode: str | None = None, texts: DataFrame | None = None, extractor: Callable[[str], str] | None = None, limit: int = triage.DEEP_LIMIT,
    on_progress: Callable[[tuple[str, str, str]], None] | None = None,
) -> Run:
    """Run over the files below ``root`` and write all tables below ``store``; only one run at a time on a store.

    Of runs by several drivers one holds the store's lease, if the store is a path of a file system that they share; for
    other addresses (object stores) only runs of this process are kept apart.
    ``mode``: see ``through_day``.  ``texts``: path, text, page_count of PDF files.  ``extractor``: text to an answer.
    """
    if not ONE_AT_A_TIME.acquire(blocking=False):
        raise RuntimeError("a run is going on")
    try:
        path = local_path(store)
        with nullcontext() if path is None else Lease(path) as lease:
            return _Ingest(spark, root, store, now, mode, texts, extractor, limit, on_progress, lease).run()
    finally:
        ONE_AT_A_TIME.release()


def replay(spark: SparkSession, root: str, store: str, now: str, days: list[str], **options) -> list[Run]:
    """A run over the base, then one for each further day of drops, each upon the one before it."""
    return [ingest(spark, root, store, now, mode, **options) for mode in (None, *sorted(days))]


class _Ingest:
    def __init__(self, spark, root, store, now, mode, texts, extractor, limit, on_progress, lease=None):
        self.lease = lease
        self.spark, self.root, self.store, self.now, self.extractor, self.limit, self.on_progress = spark, root, store, now, extractor, limit, on_progress
        self.through, base_only = through_day(spark, root, mode)
        self.files = read_files(spark, root, self.through, base_only)
        self.texts = spark.createDataFrame([], "path string, text string, page_count int") if texts is None else texts
        log = read_table(spark, f"{store}/log", LOG).orderBy("run").collect()
        self.number, self.last = (log[-1]["run"] + 1, log[-1]["folder"]) if log else (0, None)
        self.token, self.complete = uuid4().hex, [r["token"] for r in log]
        self.out, self.told = Run(f"{store}/runs/{self.number:06d}"), set()

    def tell(self, stage: str, message: str, level: str = "success") -> None:
        """An event, with the numbers of rows written since the one before; others can read it at once."""
        if self.lease is not None:
            self.lease.renew()
        self.out.events.append((stage, level, message))
        rows = {k: v for k, v in self.out.rows.items() if k not in self.told}
        self.told |= rows.keys()
        write_lines(self.spark.createDataFrame([(len(self.out.events) - 1, stage, level, message, rows)], EVENTS), f"{self.out.folder}/events", append=len(self.out.events) > 1)
        if self.on_progress:
            self.on_progress((stage, level, message))

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        self.out.rows[name] = written(rows, f"{self.out.folder}/{name}", "overwrite")
        self.out.tables[name] = self.spark.read.schema(rows.schema).parquet(f"{self.out.folder}/{name}")
        return self.out.tables[name]

    def table(self, name: str, schema, key: list[str]) -> Versions:
        """The table of versions of this name, as the last complete run left it."""
        empty = self.spark.createDataFrame([], schema)
        return Versions(self.spark, f"{self.store}/tables/{name}", empty.schema, key, self.token, self.complete)

    def put(self, name: str, table: Versions, rows: DataFrame, keys: DataFrame | None) -> Delta:
        """Add to a table; its rows are then those that count now."""
        delta = table.put(rows, keys)
        self.out.rows[name], self.out.tables[name] = delta.written, table.read()
        return delta

    def before(self, name: str, schema) -> DataFrame:
        """A table of the last run, empty on the first one."""
        return self.spark.createDataFrame([], schema) if self.last is None else self.spark.read.schema(schema).parquet(f"{self.last}/{name}")

    def run(self) -> Run:
        sources = self.sources()
        index = self.entities()
        items, assigned = self.work(sources)
        self.links(sources, items, assigned, index)
        observations = self.observations(sources, items, assigned)
        self.facts(observations, index)
        self.views(index)
        self.coverage(items, assigned)
        write_lines(self.spark.createDataFrame([(self.number, self.now, self.through, self.out.folder, self.token)], LOG), f"{self.store}/log", append=True)
        return self.out

    def sources(self) -> DataFrame:
        scanned = self.keep("scanned", registry.scan(self.files, self.before("manifest", registry.MANIFEST_SCHEMA), self.now))
        self.tell("scan", f"Inventory scan found {self.out.rows['scanned']} source file(s).")
        first = self.keep("registered", registry.build_registry(scanned, self.before("registry", registry.REGISTRY_SCHEMA), normalize.NORMALIZER_VERSION))
        fresh = self.keep("normalized", normalize.normalize(first, self.files, self.texts))
        whole = self.keep("registry", normalize.registered(first, fresh).select(*first.columns))
        ready = whole.where("status = 'normalized'")
        texts = self.table("documents", fresh.schema, ["source_id"])
        gone = texts.read().select("source_id").join(ready.select("source_id"), "source_id", "left_anti")
        # What is known of these sources is replaced or dropped, in each table by source.
        self.renewed = self.keep("renewed", fresh.select("source_id").unionByName(gone).distinct())
        documents = self.put("documents", texts, fresh.where("status = 'normalized'"), self.renewed)
        self.fresh = documents.rows
        again = ready.join(self.renewed, "source_id", "left_anti")
        self.keep("manifest", registry.synced_status(scanned, whole, "source_id").select(*registry.MANIFEST))
        totals = whole.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("normalized", "duplicate", "ignored", "error")]).first()
        self.out.counts |= totals.asDict() | {"manifest_items": self.out.rows["scanned"], "reused_normalized": again.count()}
        self.tell("normalize", f"Normalization complete: {totals['normalized']} normalized, {self.out.counts['reused_normalized']} reused.")
        return self.keep("sources", registry.eligible(whole).join(self.out["documents"].select("source_id", "meta"), "source_id", "left"))

    def entities(self) -> DataFrame:
        whole = self.out["registry"]
        own = whole.join(self.fresh.select("source_id"), "source_id", "left_semi")
        rows = normalize.records(own, self.files).join(own.select("source_id", "path"), "source_id")
        self.put("records", self.table("records", rows.schema, ["source_id"]), rows, self.renewed)
        index = self.keep("entities", entities.build_index(self.out["records"], whole, PROPERTY_ID))
        self.keep("aliases", entities.build_aliases(index))
        self.out.counts["entities"] = self.out.rows["entities"]
        self.tell("entities", f"Entity index contains {self.out.counts['entities']} entities.")
        return index

    def work(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        assigned = self.keep("members", workqueue.members(sources))
        items = self.keep("queue", workqueue.work_items(assigned, sources))
        self.out.counts["work_items"] = self.out.rows["queue"]
        self.tell("queue", f"Work queue contains {self.out.counts['work_items']} item(s).")
        return items, assigned

    def links(self, sources: DataFrame, items: DataFrame, assigned: DataFrame, index: DataFrame) -> None:
        text = linking.searched_text(F.col("path"), F.col("source_date"), F.col("declared_ids"), F.col("text"))
        searched = lambda docs: sources.join(docs.select("source_id", "text"), "source_id").select("source_id", text.alias("text"))
        fresh, old = searched(self.fresh), searched(self.out["documents"].join(self.renewed, "source_id", "left_anti"))
        folded = linking.searched_aliases(self.out["aliases"].withColumn("folded", fold_search(F.col("alias"))))
        terms = self.keep("terms", folded.select("folded").distinct())
        new_terms = self.keep("new_terms", terms.join(self.before("terms", terms.schema), "folded", "left_anti"))
        seen_fresh, seen_old = Observation(), Observation()
        size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")
        look = lambda docs, wanted, seen: linking.contained(docs.select("source_id", fold_search(F.col("text")).alias("text")), wanted, "source_id", "text", "folded", (seen, size))
        # New texts against all terms, old ones against new terms only.
        hits = look(fresh, terms, seen_fresh)
        old_searched = self.last is not None and self.out.rows["new_terms"] > 0
        if old_searched:
            hits = hits.unionByName(look(old, new_terms, seen_old))
        self.put("alias_hits", self.table("alias_hits", HITS, ["source_id"]), hits, self.renewed)
        self.out.counts |= {"searched_bytes_new": seen_fresh.get["bytes"], "searched_bytes_old": seen_old.get["bytes"] if old_searched else 0}
        self.put("named", self.table("named", NAMED, ["source_id"]), fresh.select("source_id", F.explode(mentions(F.col("text"))).alias("entity_id")), self.renewed)
        eligible = sources.select("source_id")
        direct = self.keep(
            "direct",
            linking.property_scope(sources, PROPERTY_ID)
            .unionByName(linking.mention_links(sources.select("source_id", F.explode("declared_ids").alias("entity_id")), index, "declared_id"))
            .unionByName(linking.mention_links(self.out["named"].join(eligible, "source_id", "left_semi"), index, "declared_id"))
            .unionByName(linking.links_of_hits(self.out["alias_hits"].join(eligible, "source_id", "left_semi"), folded)).distinct(),
        )
        edges = entities.relation_edges(index).unionByName(linking.building_edges(index, PROPERTY_ID)).distinct()
        dated = direct.join(sources.select("source_id", F.col("source_date").alias("day")), "source_id")
        candidates = self.keep("candidates", direct.unionByName(linking.expand(dated, edges, linking.tenancies(index))).distinct())
        members = assigned.join(items.select("work_item_id", "kind", "group_key"), ["kind", "group_key"]).select("work_item_id", "source_id")
        united = self.keep("item_candidates", linking.item_candidates(members, candidates))
        own = linking.link_records(sources, candidates, index, "source_id", PROPERTY_ID)
        theirs = linking.link_records(items, united, index, "work_item_id", PROPERTY_ID)
        records = self.keep("links", linking.union_records(own, theirs))
        summary = linking.link_summary(records).first().asDict()
        self.out.counts |= summary
        self.out.counts |= {"source_records": self.out.rows["sources"], "work_item_records": self.out.rows["queue"]}
        self.tell("entity_linking", f"Entity linking complete: {self.out.rows['sources']} source records, {self.out.rows['queue']} work-item records, {summary['unlinked']} unlinked.")

    def observations(self, sources: DataFrame, items: DataFrame, assigned: DataFrame) -> list[Delta]:
        table = self.table("deterministic", f"{OBSERVED}, {SUBJECT}", ["work_item_id"])
        before = table.read()
        held, open_ = registry.split_reuse(items.select("work_item_id", "input_hash"), before, ["work_item_id", "input_hash"])
        open_ = self.keep("reread", open_)
        fresh = items.join(open_, ["work_item_id", "input_hash"], "left_semi")
        members = assigned.join(fresh.select("kind", "group_key"), ["kind", "group_key"], "left_semi")
        found = extract.route(sources, self.out["records"].select("source_id", "field", "line_no", "row"), fresh, members, PROPERTY_ID)
        gone = before.select("work_item_id").distinct().join(items.select("work_item_id"), "work_item_id", "left_anti")
        deltas = [self.renew("deterministic", table, facts.subjects(found), open_.select("work_item_id").unionByName(gone))]
        plain = self.out["deterministic"]
        summary = extract.extraction_summary(items, held, plain).first().asDict()
        self.out.counts |= {f"extraction_{k}": v for k, v in summary.items()}
        self.tell("deterministic_extraction", f"Deterministic extraction produced {summary['observations']} observations, {summary['reused']} work items reused.")
        ids = assigned.join(items.select("work_item_id", "kind", "group_key"), ["kind", "group_key"]).select("work_item_id", "source_id")
        links = self.out["item_candidates"].select("work_item_id", "entity_id", "match_type", "inherited_from")
        hashed = triage.item_hash(items, links, SEMANTIC_VERSION, "none" if self.extractor is None else "given", self.limit)
        decided_schema = "work_item_id string, input_hash string, categories array<string>, decision string, reason string, decision_id string"
        kept, wanted = triage.reused(hashed, self.before("decisions", decided_schema))
        texts = triage.item_texts(items.where("kind = 'email_thread'").join(wanted, "work_item_id", "left_semi"), ids, self.out["documents"].select("source_id", "text"))
        asked = items.drop("input_hash").join(wanted, "work_item_id").join(texts, "work_item_id", "left").select("work_item_id", "input_hash", "kind", F.col("glimpse.sourceCount").cast("int").alias("sources"), F.col("day").isNotNull().alias("recent"), "text")
        decisions = self.keep("decisions", kept.select("work_item_id", "input_hash", "categories", "decision", "reason", "decision_id").unionByName(triage.decide(asked, self.limit, self.extractor is not None)))
        self.out.counts |= {f"decided_{k}": v for k, v in triage.decision_counts(decisions).first().asDict().items()}
        self.tell("semantic_extraction", f"{self.out.counts['decided_decisions']} work items decided.")
        semantics = self.table("semantic", f"{OBSERVED}, {SUBJECT}", ["work_item_id"])
        earlier = semantics.read()
        if self.extractor is None:
            deltas.append(self.renew("semantic", semantics, earlier.limit(0), earlier.select("work_item_id")))
            return deltas
        chosen = decisions.where("decision = 'deep_extract'").select("work_item_id", "input_hash")
        answers = self.keep("answers", triage.extract(chosen.join(texts, "work_item_id").select(F.col("work_item_id").alias("id"), "text"), self.extractor))
        allowed = links.groupBy("work_item_id").agg(F.slice(F.array_sort(F.collect_set("entity_id")), 1, linking.MOST_CANDIDATES).alias("allowed"))
        own = ids.join(chosen.select("work_item_id"), "work_item_id", "left_semi").groupBy("work_item_id").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
        told = chosen.join(answers.where("answer IS NOT NULL").select(F.col("id").alias("work_item_id"), "answer"), "work_item_id").join(own, "work_item_id").join(allowed, "work_item_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
        semantic = triage.supported(told, PROPERTY_ID)
        evidence = F.transform("evidence", lambda e: F.struct(e["sourceId"].alias("sourceId"), F.lit(None).cast("string").alias("normalizedPath"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("long").alias("lineStart"), F.lit(None).cast("long").alias("lineEnd"), e["quote"].alias("quote")))
        told = semantic.withColumn("evidence", evidence.cast(f"array<{extract.EVIDENCE}>")).select(*[c for c in semantics.schema.names if c not in ("fact_kind", "subject_id")])
        answered = self.keep("semantic_now", facts.subjects(told))
        deltas.append(self.renew("semantic", semantics, answered, earlier.select("work_item_id").unionByName(answered.select("work_item_id"))))
        return deltas

    def renew(self, name: str, table: Versions, rows: DataFrame, items: DataFrame) -> Delta:
        """Put observations in place of those of ``items``; what these were is kept as ``<name>_withdrawn``."""
        keys = self.keep(f"{name}_items", items.distinct())
        self.keep(f"{name}_withdrawn", table.read().join(keys, "work_item_id", "left_semi").select("fact_kind", "subject_id").distinct())
        return self.put(name, table, rows, keys)

    def facts(self, deltas: list[Delta], index: DataFrame) -> None:
        """Reduce the subjects again that observations came to or went from, or whose entity is described otherwise."""
        every = extract.union(self.out["deterministic"], self.out["semantic"])
        described = changes.compare(self.before("entities", index.schema), index, "entity_id", [c for c in index.columns if c != "entity_id"]).where("status <> 'unchanged'")
        subjects = every.select("fact_kind", "subject_id")
        touched = subjects.join(described.select(F.col("entity_id").alias("subject_id")), "subject_id", "left_semi").select("fact_kind", "subject_id") if self.last is not None else subjects.limit(0)
        for name, delta in zip(("deterministic", "semantic"), deltas, strict=True):
            touched = touched.unionByName(delta.rows.select("fact_kind", "subject_id")).unionByName(self.out[f"{name}_withdrawn"])
        touched = self.keep("touched_subjects", touched.distinct())
        made, sources, named, evidence = facts.build_facts(every.join(touched, ["fact_kind", "subject_id"], "left_semi"), index)
        now = self.keep("facts_now", made)
        kept = self.table("facts", now.schema, ["kind", "subject_id"])
        all_before = kept.read()
        earlier = self.keep("facts_before", all_before.join(touched.withColumnRenamed("fact_kind", "kind"), ["kind", "subject_id"], "left_semi").select(*now.columns))
        unmoved = all_before.count() - self.out.rows["facts_before"]
        self.put("facts", kept, now, touched.withColumnRenamed("fact_kind", "kind"))
        ids = self.keep("touched_facts", now.select("fact_id").unionByName(earlier.select("fact_id")).distinct())
        before_of = {}
        for name, rows in {"fact_sources": sources, "fact_entities": named, "fact_evidence": evidence}.items():
            table = self.table(name, rows.schema, ["fact_id"])
            before_of[name] = table.read()
            self.put(name, table, rows, ids)
        compared = self.keep("compared", changes.compare(earlier, now, "fact_id", [c for c in now.columns if c != "fact_id"]))
        summary = changes.change_summary(compared).first().asDict()
        summary = {k: v + (unmoved if k in ("previous", "following", "unchanged") else 0) for k, v in summary.items()}
        self.out.counts |= {f"facts_{k}": v for k, v in summary.items()}
        changed_ids = self.keep("changes", compared.where("status <> 'unchanged'"))
        gone = earlier.join(now.select("fact_id"), "fact_id", "left_anti")
        changed = now.unionByName(gone).join(changed_ids.select("fact_id"), "fact_id", "left_semi")
        lists = self.out["fact_entities"].join(changed_ids.select("fact_id"), "fact_id", "left_semi").unionByName(before_of["fact_entities"].join(gone.select("fact_id"), "fact_id", "left_semi").join(changed_ids.select("fact_id"), "fact_id", "left_semi"))
        ends = changes.changed_entities(changed.withColumn("entities", F.array().cast("array<string>")), PROPERTY_ID) if self.out.rows["changes"] else lists.select("entity_id").limit(0)
        entities_ = self.keep("changed_entities", ends.unionByName(lists.select("entity_id")).distinct())
        both = self.out["fact_sources"].unionByName(before_of["fact_sources"])
        self.keep("changed_sources", changes.changed_sources(changed_ids, both))
        self.keep("affected_views", changes.affected_views(changed, entities_, index, PROPERTY_ID))
        self.tell("facts", f"Fact index contains {summary['following']} facts. Changes: +{summary['added']}, ~{summary['modified']}, -{summary['removed']}.")

    def views(self, index: DataFrame) -> None:
        made, sources, touched, evidence = (self.out[n] for n in ("facts", "fact_sources", "fact_entities", "fact_evidence"))
        sections = Sections(made, sources, touched, evidence, index, PROPERTY_ID)
        built = self.keep("sections", sections.build())
        self.keep("section_facts", sections.fact_ids())
        document_schema = "text string"
        old = self.before("document", document_schema)
        existing = views.sections_of(old.withColumn("key", F.lit(PROPERTY_ID)), "key", "text")
        merged = views.merge_sections(existing, built)
        log = self.keep("patch_log", views.patch_log(merged, existing, self.now, PROPERTY_ID, initial=self.last is None))
        if self.last is None:
            self.keep("document", views.initial_document(built, PROPERTY_ID, self.now))
        else:
            # One document of bounded sections.
            text = views.merge_document(old.first()["text"], [(r["section_id"], r["content"], r["hash"]) for r in built.orderBy("place").collect()], self.now)
            self.keep("document", self.spark.createDataFrame([(text,)], document_schema))
        pages = self.keep("entity_documents", views.entity_documents(index, made, sources, touched, evidence, PROPERTY_ID, self.now))
        self.keep("view_manifest", views.page_dependencies(views.page_facts(made, touched, index), touched, PROPERTY_ID))
        counted = log.agg(F.count_if(F.col("status") == "applied").alias("patched"), F.count_if(F.col("status") == "conflict").alias("conflicts")).first().asDict()
        self.out.counts |= counted | {"entity_documents": pages.count()}
        self.tell("context", f"Context materialized: {counted['patched']} patched section(s), {counted['conflicts']} conflict(s).", "warning" if counted["conflicts"] else "success")

    def coverage(self, items: DataFrame, assigned: DataFrame) -> None:
        done = self.keep("work_item_states", workqueue.outcomes(items, self.out["deterministic"], self.out["decisions"]))
        counts = self.keep("coverage", registry.coverage_counts(self.out["registry"], done, assigned))
        self.keep("coverage_report", registry.coverage_document(counts, registry.coverage_faults(self.out["registry"], assigned), PROPERTY_ID, self.now))
        row = counts.first()
        self.out.counts |= {f"coverage_{k}": v for k, v in row.asDict().items()}
        self.tell("coverage", f"Coverage validated: {row['assigned']}/{row['eligible']} sources assigned.", "success" if row["result"] == "PASS" else "warning")

"""Inventory against the previous run, exact duplicates, reuse of earlier results, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import naming

#: Columns of a manifest.
MANIFEST = ["source_id", "kind", "path", "raw_sha256", "bytes", "discovered_at", "updated_at", "status", "declared_ids", "source_date", "day"]
MANIFEST_SCHEMA = "source_id string, kind string, path string, raw_sha256 string, bytes long, discovered_at string, updated_at string, status string, declared_ids array<string>, source_date string, day string"
REGISTRY_SCHEMA = f"{MANIFEST_SCHEMA}, ignore_reason string, duplicate_of string, normalized_paths array<string>, normalized_sha256 string, normalizer_version int"
#: Kinds that are listed but never processed.
IGNORED_KINDS = ("system_file", "unknown")
#: States in which a work item is done.
TERMINAL = ("processed", "ignored", "error")


def unique_ids(rows: DataFrame, base_id: str, order: str, raw_hash: str) -> DataFrame:
    """``rows`` with ``source_id``: the base id, and for all but its first row in ``order`` also 8 digits of the hash.

    The first is an aggregate joined back, so that a base id of very many rows is never sorted.
    """
    first = rows.groupBy(base_id).agg(F.min(order).alias("_first"))
    suffix = F.concat(F.lit("__"), F.substring(raw_hash, 1, 8))
    own = F.when(F.col(order) == F.col("_first"), F.col(base_id)).otherwise(F.concat(F.col(base_id), suffix))
    return rows.join(first, base_id).withColumn("source_id", own).drop("_first")


def scan(files: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """The manifest of a run: source_id, kind, path, raw_sha256, bytes, discovered_at, updated_at, status, declared_ids, source_date, day.

    ``files``: path, bytes, raw_sha256; ``previous``: the last run's manifest.  System files and unknown kinds are
    ignored; a file whose hash differs from before is changed; others are discovered, those that are as before too.
    Paths that are gone stay as deleted, with what was known of them.
    """
    path = F.col("path")
    told = files.select("path", "bytes", "raw_sha256", naming.classify(path).alias("kind"), naming.declared_ids(path).alias("declared_ids"), naming.name_date(path).alias("source_date"), naming.incremental_day(path).alias("day"))
    named = unique_ids(told.withColumn("base_id", naming.source_id(path, F.col("declared_ids"), F.col("raw_sha256"))), "base_id", "path", "raw_sha256").drop("base_id")
    before = previous.select("path", F.struct(*MANIFEST).alias("old"))
    joined = named.withColumn("here", F.lit(True)).join(before, "path", "full_outer")
    changed = F.col("old").isNotNull() & (F.col("old.raw_sha256") != F.col("raw_sha256"))
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("kind").isin(*IGNORED_KINDS), "ignored").when(changed, "changed").otherwise("discovered")
    kept = {c: F.when(F.col("here").isNull(), F.col(f"old.{c}")).otherwise(F.col(c)) for c in ("source_id", "kind", "raw_sha256", "bytes", "declared_ids", "source_date", "day")}
    return joined.select(
        "path", *[v.alias(c) for c, v in kept.items()], F.coalesce("old.discovered_at", F.lit(now)).alias("discovered_at"), F.lit(now).alias("updated_at"), status.alias("status")
    ).select(*MANIFEST)


def diff_manifests(current: DataFrame, previous: DataFrame, key: str, raw_hash: str) -> DataFrame:
    """(key, raw_hash, previous_hash, status) over both runs: discovered, changed or deleted.

    A file that is as before counts as discovered.  Deleted ones keep the hash they had.
    """
    now = current.select(F.col(key), F.col(raw_hash).alias("now"))
    before = previous.select(F.col(key), F.col(raw_hash).alias("before"))
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("before").isNotNull() & (F.col("now") != F.col("before")), "changed").otherwise("discovered")
    return now.join(before, key, "full_outer").select(key, F.coalesce("now", "before").alias(raw_hash), F.col("before").alias("previous_hash"), status.alias("status"))


def mark_duplicates(rows: DataFrame, id_col: str, raw_hash: str, order: str, usable: Column | None = None) -> DataFrame:
    """``rows`` with ``duplicate_of``: the id of the first row of equal hash, null for that one and for null hashes.

    Rows that aren't ``usable`` (ignored or deleted ones) neither are duplicates nor have any.  The first of each hash
    is an aggregate joined back, so that a hash with very many rows is never sorted.
    """
    good = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    flagged = rows.withColumn("_good", good)
    first = flagged.where("_good").groupBy(raw_hash).agg(F.min(F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"))).alias("_first"))
    joined = flagged.join(first, raw_hash, "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_good") & (F.col("_first.i") != F.col(id_col)), F.col("_first.i"))).drop("_first", "_good")


def registry_aliases(marked: DataFrame, id_col: str) -> DataFrame:
    """(id, alias): a row per duplicate of a primary row, so that a large group of copies is never one row."""
    return marked.where("duplicate_of IS NOT NULL").select(F.col("duplicate_of").alias(id_col), F.col(id_col).alias("alias"))


def registry_status(kind: Column, status: Column, duplicate_of: Column) -> Column:
    return F.when(status == "deleted", status).when(kind.isin(*IGNORED_KINDS), "ignored").when(duplicate_of.isNotNull(), "duplicate").otherwise(status)


def ignore_reason(kind: Column) -> Column:
    return F.when(kind == "system_file", "System metadata file").when(kind == "unknown", "Unsupported source kind")


def build_registry(manifest: DataFrame, previous: DataFrame, normalizer_version: int) -> DataFrame:
    """The manifest's sources with status, ignore_reason, duplicate_of, normalized_paths, normalized_sha256, normalizer_version.

    Of the sources that are neither ignored nor deleted, the first path of each hash is primary and the others are
    duplicates.  A discovered primary whose path, hash and kind an earlier registry normalized by this version keeps
    that result and counts as normalized.
    """
    usable = (F.col("status") != "deleted") & ~F.col("kind").isin(*IGNORED_KINDS)
    marked = mark_duplicates(manifest, "source_id", "raw_sha256", "path", usable)
    ruled = marked.withColumns({"status": registry_status(F.col("kind"), F.col("status"), F.col("duplicate_of")), "ignore_reason": F.when(F.col("status") != "deleted", ignore_reason(F.col("kind")))})
    done = reusable(previous, normalizer_version).select("path", "raw_sha256", "kind", "normalized_paths", "normalized_sha256", "normalizer_version", F.lit(True).alias("_done")).dropDuplicates(["path", "raw_sha256", "kind"])
    joined = ruled.join(done, ["path", "raw_sha256", "kind"], "left")
    again = F.coalesce(F.col("_done") & (F.col("status") == "discovered"), F.lit(False))
    none = F.array().cast("array<string>")
    return joined.select(
        *[c for c in MANIFEST if c != "status"], F.when(again, "normalized").otherwise(F.col("status")).alias("status"), "ignore_reason", "duplicate_of",
        F.when(again, F.col("normalized_paths")).otherwise(none).alias("normalized_paths"),
        *[F.when(again, F.col(c)).alias(c) for c in ("normalized_sha256", "normalizer_version")],
    )


def registry_totals(rows: DataFrame) -> DataFrame:
    """One row: sources, duplicates and ignored ones."""
    return rows.agg(
        F.count("*").alias("source_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"),
        F.count_if(F.col("status") == "ignored").alias("ignored_count"),
    )


def synced_status(manifest: DataFrame, registry: DataFrame, id_col: str) -> DataFrame:
    """The manifest with the status that the registry now has for each source."""
    now = registry.select(id_col, F.col("status").alias("now"))
    return manifest.join(now, id_col, "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def split_reuse(wanted: DataFrame, previous: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(previous rows that answer a wanted one, wanted rows that none answers)."""
    return previous.join(wanted.select(*keys), keys, "left_semi"), wanted.join(previous.select(*keys), keys, "left_anti")


def reusable(previous: DataFrame, normalizer_version: int) -> DataFrame:
    """Rows of an earlier registry whose normalized form may be used again."""
    done = F.col("status").isin("normalized", "queued", "processed")
    return previous.where(done & (F.size("normalized_paths") > 0) & (F.col("normalizer_version") == normalizer_version))


def eligible(registry: DataFrame) -> DataFrame:
    return registry.where((F.col("status") == "normalized") & (F.size("normalized_paths") > 0))


def coverage(expected: DataFrame, assigned: DataFrame, id_col: str) -> DataFrame:
    """One row: expected, assigned, missing, unknown and repeated sources, and whether each is assigned once.

    ``assigned`` has a row for each assignment.
    """
    times = assigned.groupBy(id_col).agg(F.count("*").alias("times"))
    both = expected.select(id_col, F.lit(True).alias("expected")).dropDuplicates([id_col]).join(times, id_col, "full_outer")
    known, got = F.coalesce("expected", F.lit(False)), F.coalesce("times", F.lit(0))
    counted = both.agg(
        F.count_if(known).alias("expected"),
        F.count_if(known & (got > 0)).alias("assigned"),
        F.count_if(known & (got == 0)).alias("missing"),
        F.count_if(~known).alias("unknown"),
        F.count_if(got > 1).alias("repeated"),
    )
    good = (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0)
    return counted.withColumn("result", F.when(good, "PASS").otherwise("FAIL"))


def coverage_faults(registry: DataFrame, assigned: DataFrame) -> DataFrame:
    """(fault, source_id): eligible sources without a work item, sources with several, normalized ones without artifacts.

    fault: ``missing``, ``duplicate`` or ``no_artifact``.  ``assigned``: a row per source and work item.
    """
    times = assigned.groupBy("source_id").agg(F.count("*").alias("times"))
    missing = eligible(registry).select("source_id").join(times, "source_id", "left_anti").select(F.lit("missing").alias("fault"), "source_id")
    twice = times.where("times > 1").select(F.lit("duplicate").alias("fault"), "source_id")
    bare = registry.where((F.col("status") == "normalized") & (F.size("normalized_paths") == 0)).select(F.lit("no_artifact").alias("fault"), "source_id")
    return missing.unionByName(twice).unionByName(bare)


def coverage_counts(registry: DataFrame, items: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: sources, eligible and assigned ones, work items, terminal and pending ones, faults, and the result.

    ``items``: work_item_id, status; processed, ignored and failed ones are terminal.
    """
    sources = registry.agg(F.count("*").alias("sources"), F.count_if((F.col("status") == "normalized") & (F.size("normalized_paths") > 0)).alias("eligible"))
    faults = coverage_faults(registry, assigned).agg(*[F.count_if(F.col("fault") == x).alias(x) for x in ("missing", "duplicate", "no_artifact")])
    work = items.agg(F.count("*").alias("work_items"), F.count_if(F.col("status").isin(*TERMINAL)).alias("terminal"))
    one = sources.join(F.broadcast(faults)).join(F.broadcast(work))
    good = (F.col("missing") == 0) & (F.col("duplicate") == 0) & (F.col("no_artifact") == 0)
    return one.select(
        "sources", "eligible", (F.col("eligible") - F.col("missing")).alias("assigned"), "work_items", "terminal", (F.col("work_items") - F.col("terminal")).alias("pending"),
        "missing", "duplicate", "no_artifact", F.when(good, "PASS").otherwise("FAIL").alias("result"),
    )


def coverage_report(counted: DataFrame) -> DataFrame:
    """The coverage row as Markdown lines in ``text``."""
    lines = [F.concat(F.lit("Result: "), F.col("result"))] + [F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in ("expected", "assigned", "missing", "unknown", "repeated")]
    return counted.select(F.concat_ws("\n", F.lit("# Coverage"), F.lit(""), *lines).alias("text"))


def coverage_document(counted: DataFrame, faults: DataFrame, property_id: str, now: str) -> DataFrame:
    """The full report, a Markdown line per row (place, line), so that a long list of faults is never one row."""
    shown = {"Source assignment status": "result", "Sources": "sources", "Eligible normalized sources": "eligible", "Assigned normalized sources": "assigned", "Work items": "work_items", "Terminal work items": "terminal", "Pending work items": "pending"}
    head = [F.lit("# Coverage Report"), F.lit(""), F.lit(f"- Property: {property_id}"), F.lit(f"- Generated: {now}")] + [F.concat(F.lit(f"- {k}: "), F.col(c).cast("string")) for k, c in shown.items()] + [F.lit("")]
    titles = {"missing": "Missing Assignments", "duplicate": "Duplicate Assignments", "no_artifact": "Normalized Sources Missing Artifacts"}
    pending = F.when(F.col("pending") > 0, "- Work items are queued and pending extraction. Terminal outcome validation starts after extraction writes observations, ignore decisions, or errors.").otherwise("- All work items have terminal outcomes.")
    rows = lambda part, lines: counted.select(F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("n", "line")).select("part", F.lit("").alias("id"), "n", "line")
    out = rows(0, head)
    for part, (fault, title) in enumerate(titles.items(), 1):
        listed = faults.where(F.col("fault") == fault).select(F.lit(3 * part + 1).alias("part"), F.col("source_id").alias("id"), F.lit(0).alias("n"), F.concat(F.lit("- "), "source_id").alias("line"))
        none = counted.where(F.col(fault) == 0).select(F.lit(3 * part + 1).alias("part"), F.lit("").alias("id"), F.lit(0).alias("n"), F.lit("- None").alias("line"))
        out = out.unionByName(rows(3 * part, [F.lit(f"## {title}"), F.lit("")])).unionByName(listed).unionByName(none).unionByName(rows(3 * part + 2, [F.lit("")]))
    out = out.unionByName(rows(99, [F.lit("## Extraction Outcomes"), F.lit(""), pending]))
    return out.select(F.struct("part", "id", "n").alias("place"), "line")

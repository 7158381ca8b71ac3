"""Views of facts: sections with hashes, merging with edits, protected blocks, line differences, pages of entities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import epoch_millis
from factloom.functions.text import attribute_text, file_stem, first_quote, json_id, markdown_table, missing_if_blank, protected_text, source_reference
from factloom.operators.entities import is_viewed, related_entities
from factloom.operators.facts import first_values

# How many rows pages show, kinds that stay active, markers of sections and blocks, texts of documents,
# reasons in the patch log.
ACTIVE, RECENT, SOURCES_SHOWN, PAGE_QUOTE = 40, 80, 5, 220
ACTIVE_KINDS = ("issue", "deadline", "obligation", "risk")
USER_BLOCK = r"(?is)<user\b[^>]*>.*?</user>"
SECTION_START, SECTION_HASH, SECTION_END = "<!-- BCE:SECTION ", " START hash=", " END -->"
SECTION_PATTERN = r"(?s)<!-- BCE:SECTION (\S+) START hash=([a-f0-9]+) -->\n(.*?)\n<!-- BCE:SECTION \1 END -->"
NOTES_HEADING = "## Human And Agent Notes"
PREFACE = [
    "This file is a dense materialized view for agents. The source of truth is the structured artifact chain: source registry, entity index, observations, fact index, and patch log.", "",
    "Human notes can be added outside BCE managed sections. Managed sections are bounded by BCE markers and carry content hashes for surgical updates.",
    "Text inside <user>...</user> tags is protected human-confirmed context. Never delete, rewrite, summarize away, move, or overwrite it. If generated evidence conflicts with a <user> block, preserve the <user> block and add any new generated information around it.", "",
]
PAGE_NOTE = "This is a generated scoped materialized view. Source of truth remains source-registry, entity-index, observations, fact-index, and patch log."
REASONS = {
    "initial": "Initial Context.md generation", "append": "Added missing managed section", "replace": "Regenerated managed section from fact-index",
    "conflict": "Skipped managed section update because existing section content hash does not match marker; possible human edit inside managed block",
}
BLOCKED = "Blocked because protected <user> blocks changed."
# End of fixed values.

SPACE = r"[\s\u00a0\ufeff]"


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + r"+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(trim_end(text), 256)


# -- sections ----------------------------------------------------------------------------------------------------


def section_text(rows: DataFrame, group: list[str], line: str, order: list[str], title: Column) -> DataFrame:
    """(group, content, content_hash): a title and a section's lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line")))), lambda x: x["_line"])
    listed = rows.groupBy(*group).agg(F.concat_ws("\n", F.concat(F.lit("## "), F.first(title)), lines).alias("content"))
    return listed.withColumn("content_hash", content_hash(F.col("content")))


def wrapped(section_id: Column, content: Column, own_hash: Column | None = None) -> Column:
    """A section between its markers, the first of which holds the content's hash."""
    marked = content_hash(content) if own_hash is None else own_hash
    return F.concat(F.lit(SECTION_START), section_id, F.lit(SECTION_HASH), marked, F.lit(" -->\n"), content, F.lit(f"\n{SECTION_START}"), section_id, F.lit(SECTION_END))


def sections_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_id, marked_hash, content) of every managed section in texts."""
    found = F.regexp_extract_all(text, F.lit(SECTION_PATTERN), F.lit(0))
    one = documents.select(key, F.explode(found).alias("s"))
    part = lambda g: F.regexp_extract("s", SECTION_PATTERN, g)
    return one.select(key, part(1).alias("section_id"), part(2).alias("marked_hash"), part(3).alias("content"))


def merge_sections(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(section_id, action, content): append, conflict, keep or replace.

    ``existing``: section_id, content, marked_hash; an edited section (whose hash isn't the marked one) is a
    conflict and keeps its text.
    """
    joined = new.select("section_id", F.col("content").alias("fresh")).join(existing.select("section_id", "content", "marked_hash"), "section_id", "full_outer")
    action = (
        F.when(F.col("content").isNull(), "append")
        .when(F.col("fresh").isNull(), "keep")
        .when(content_hash(F.col("content")) != F.col("marked_hash"), "conflict")
        .when(content_hash(F.col("content")) == content_hash(F.col("fresh")), "keep")
        .otherwise("replace")
    )
    acted = joined.withColumn("action", action)
    return acted.select("section_id", "action", F.when(F.col("action").isin("append", "replace"), F.col("fresh")).otherwise(F.col("content")).alias("content"))


def patch_log(merged: DataFrame, existing: DataFrame, now: str = "", property_id: str = "", initial: bool = False) -> DataFrame:
    """(patch_id, section_id, action, status, reason, before_hash, expected_hash, after_hash, created_at) of sections that were not just kept."""
    before = existing.select("section_id", content_hash(F.col("content")).alias("before_hash"), F.col("marked_hash").alias("marked"))
    changed = merged.where("action <> 'keep'").join(before, "section_id", "left").withColumn("after_hash", content_hash(F.col("content")))
    conflict = F.col("action") == "conflict"
    reason = F.lit(REASONS["initial"]) if initial else F.element_at(F.create_map(*[F.lit(x) for k in ("append", "replace", "conflict") for x in (k, REASONS[k])]), F.col("action"))
    told = changed.select(
        "section_id", "action", F.when(conflict, "conflict").otherwise("applied").alias("status"), reason.alias("reason"), "before_hash", F.when(conflict, F.col("marked")).alias("expected_hash"), "after_hash", F.lit(property_id).alias("property_id"), F.lit(now).alias("created_at")
    )
    identity = json_id("PATCH", sectionId=F.col("section_id"), beforeHash=F.col("before_hash"), expectedBeforeHash=F.col("expected_hash"), afterHash=F.col("after_hash"), status=F.col("status"), now=F.col("created_at"))
    return told.withColumn("patch_id", identity)


def initial_document(sections: DataFrame, property_id: str, now: str) -> DataFrame:
    """(text): a new document of ``sections`` (section_id, place, content, hash)."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("place", wrapped(F.col("section_id"), F.col("content"), F.col("hash")).alias("text")))), lambda x: x["text"])
    head = [f"# Context: {property_id}", "", f"Generated: {now}", "", *PREFACE]
    return sections.agg(F.concat(F.lit("\n".join(head) + "\n"), F.array_join(body, "\n"), F.lit("\n")).alias("text"))


def merge_document(existing: str, sections: list[tuple[str, str, str]], now: str) -> str:
    """An existing document with regenerated sections (section_id, content, hash), for one document's text.

    Its line ``Generated:`` is renewed.  Sections whose text isn't what their marker says stay as they are, missing
    ones are added at the end.  Raises if a protected block would change.
    """
    if "Generated:" in existing:
        text = re.sub(r"(?m)^Generated: .*$", lambda _: f"Generated: {now}", existing, count=1)
    else:
        text = re.sub(r"(?m)^# Context:.*$", lambda m: f"{m[0]}\n\nGenerated: {now}", existing, count=1)
    for section_id, content, own in sections:
        fresh = f"{SECTION_START}{section_id}{SECTION_HASH}{own} -->\n{content}\n{SECTION_START}{section_id}{SECTION_END}"
        pattern = re.compile(SECTION_PATTERN.replace(r"(\S+)", f"({re.escape(section_id)})"))
        if not (found := pattern.search(text)):
            text = f"{text.rstrip()}\n\n{fresh}\n"
        elif text_hash(found[3]) == found[2]:
            text = text[: found.start()] + fresh + text[found.end() :]
    guard(existing, text)
    return text if text.endswith("\n") else f"{text}\n"


def text_hash(text: str) -> str:
    from hashlib import sha256

    return sha256(text.rstrip().encode()).hexdigest()


# -- protected blocks --------------------------------------------------------------------------------------------


def user_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(USER_BLOCK), F.lit(0))


def blocks_unchanged(before: Column, after: Column) -> Column:
    """Whether both texts hold the same protected blocks, byte by byte and in order."""
    return user_blocks(before) == user_blocks(after)


def guard(before: str, after: str) -> str:
    """``after``, unless its protected blocks aren't those of ``before``: then it raises."""
    if re.findall(USER_BLOCK, before) != re.findall(USER_BLOCK, after):
        raise ValueError(BLOCKED)
    return after


def protected_block(author: Column, text: Column) -> Column:
    return F.concat(F.lit('<user author="'), attribute_text(author), F.lit('">\n'), protected_text(text), F.lit("\n</user>"))


def split_lines(text: str) -> list[str]:
    return re.split(r"\r?\n", text)


def line_changes(before: list[str], after: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(operation, from, to, from, to) of a longest common subsequence of lines: equal, insert, delete, replace.

    Where several are longest, lines of ``before`` are dropped as early as possible.  Rows of lengths are computed from
    the last line on, all columns of a row at once; only every so many rows are kept, and those between computed again
    on the way forward, so that memory grows with the square root of the lines.
    """
    import numpy as np

    known: dict[str, int] = {}
    a, b = (np.array([known.setdefault(x, len(known)) for x in lines], dtype=np.int64) for lines in (before, after))
    m, n = len(a), len(b)
    step = max(1, int(m**0.5))

    def above(row, i):
        """Row i of the lengths from row i + 1."""
        best = np.zeros(n + 1, dtype=np.int32)
        best[:n] = np.where(b == a[i], row[1:] + 1, row[:n])
        return np.maximum.accumulate(best[::-1])[::-1]

    kept, row = {m: np.zeros(n + 1, dtype=np.int32)}, np.zeros(n + 1, dtype=np.int32)
    for i in range(m - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, object] = {}

    def longer_below(i, j) -> bool:
        """Whether dropping line i of ``before`` leaves at least as much in common as dropping line j of ``after``."""
        if i not in rows or i + 1 not in rows:
            rows.clear()
            top = min(m, (i // step + 1) * step)
            rows[top] = kept[top]
            for k in range(top - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], k)
        return rows[i + 1][j] >= rows[i][j + 1]

    ops: list[list] = []

    def add(tag, a0, a1, b0, b1):
        if ops and ops[-1][0] == tag and ops[-1][2] == a0 and ops[-1][4] == b0:
            ops[-1][2], ops[-1][4] = a1, b1
        else:
            ops.append([tag, a0, a1, b0, b1])

    i = j = 0
    while i < m and j < n:
        if a[i] == b[j]:
            add("equal", i, i + 1, j, j + 1)
            i, j = i + 1, j + 1
        elif longer_below(i, j):
            add("delete", i, i + 1, j, j)
            i += 1
        else:
            add("insert", i, i, j, j + 1)
            j += 1
    if i < m:
        add("delete", i, m, j, j)
    if j < n:
        add("insert", m, m, j, n)
    out: list[tuple[str, int, int, int, int]] = []
    for op in ops:
        if op[0] == "insert" and out and out[-1][0] == "delete" and out[-1][2] == op[1] and out[-1][4] == op[3]:
            out[-1] = ("replace", out[-1][1], out[-1][2], op[3], op[4])
        else:
            out.append(tuple(op))
    return out


def plain_attribute(value: str) -> str:
    return re.sub("^-+|-+$", "", re.sub("[^A-Za-z0-9_.@-]+", "-", value))[:80] or "frontend-user"


def wrap_edits(before: str, after: str, author: str, created_at: str) -> str:
    """``after`` with what it adds, replaces or drops of ``before`` in protected blocks; raises if protected blocks differ.

    Blocks are numbered under an id of ``created_at`` (ISO time); dropped text is quoted in a block of its own.
    """
    if before == after:
        return before
    guard(before, after)
    edit_id, old, new, out, count = "USEREDIT-" + re.sub(r"\.\d{3}Z$|[-:TZ]", "", created_at), split_lines(before), split_lines(after), [], 0
    for tag, a0, a1, b0, b1 in line_changes(old, new):
        if tag == "equal":
            out += new[b0:b1]
            continue
        count += 1
        dropped = "\n".join(old[a0:a1]).strip()
        text = (f"Deleted generated context:\n\n{dropped}" if dropped else "") if tag == "delete" else "\n".join(new[b0:b1]).strip()
        safe = re.sub("(?i)</user>", "</ user>", text).strip()
        if safe:
            out += [f'<user id="{edit_id}-{count}" author="{plain_attribute(author)}" created_at="{created_at}" action="{tag}">', *split_lines(safe), "</user>"]
    result = "\n".join(out)
    return f"{result}\n" if after.endswith("\n") else result


def save_edits(pairs: DataFrame, key: str, before: str, after: str, author: str, created_at: str) -> DataFrame:
    """(key, text, error): each edited text with its changes protected, or the reason why it is refused."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, a, b in zip(pdf[key], pdf[before], pdf[after], strict=True):
                try:
                    text = wrap_edits(a or "", b or "", author, created_at)
                    rows.append((k, text if text.endswith("\n") else f"{text}\n", None))
                except ValueError as error:
                    rows.append((k, None, str(error)))
            yield pd.DataFrame(rows, columns=[key, "text", "error"])

    return pairs.select(key, before, after).mapInPandas(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, text string, error string")


def with_note(text: Column, note: Column, reason: Column, now: str) -> Column:
    """``text`` with a note under the heading for notes; without that heading, one before the first managed section, or at the end."""
    entry = F.concat(F.lit(f"- {now} agent note: "), F.trim(note), F.lit("\n  Reason: "), F.trim(reason))
    heading = F.lit(f"\n{NOTES_HEADING}\n")
    at, start = F.locate(f"\n{NOTES_HEADING}\n", text), F.locate(f"\n{SECTION_START}", text)
    notes = F.concat(F.lit(f"{NOTES_HEADING}\n\n"), entry, F.lit("\n\n"))
    rest = lambda place, skip: text.substr(place + skip, F.length(text))
    inside = F.concat(text.substr(F.lit(1), at - 1), heading, F.lit("\n"), entry, F.lit("\n"), rest(at, F.length(heading)))
    ahead = F.concat(trim_end(text.substr(F.lit(1), start - 1)), F.lit("\n\n"), notes, rest(start, F.lit(1)))
    out = F.when(at > 0, inside).when(start > 0, ahead).otherwise(F.concat(trim_end(text), F.lit("\n\n"), notes))
    return F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


def line_diffs(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, operation, before_from, before_to, after_from, after_to) of each pair of texts, unchanged parts left out."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, *op) for k, a, b in zip(pdf[key], pdf[before], pdf[after], strict=True) for op in line_changes(split_lines(a or ""), split_lines(b or "")) if op[0] != "equal"]
            yield pd.DataFrame(rows, columns=[key, "operation", "before_from", "before_to", "after_from", "after_to"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, before, after).mapInPandas(run, f"`{key}` {kind}, operation string, before_from long, before_to long, after_from long, after_to long")


def corrections(proposed: DataFrame, sections: DataFrame, property_id: str, now: str) -> DataFrame:
    """Records of proposed corrections (thread_id, correction, reason, target_section_id, and lists of targets).

    Each has an id, the hash of the section it aims at as that is now, if there is one, and its targets once each.
    """
    known = sections.select(F.col("section_id").alias("target_section_id"), content_hash(F.col("content")).alias("target_section_hash"))
    identity = json_id("CORR", threadId=F.col("thread_id"), correction=F.col("correction"), reason=F.col("reason"), now=F.lit(now))
    lists = [F.array_distinct(c).alias(c) for c in ("target_fact_ids", "target_entity_ids", "target_source_ids")]
    return proposed.join(known, "target_section_id", "left").select(
        identity.alias("correction_id"), F.lit(property_id).alias("property_id"), F.lit("proposed").alias("status"), F.trim("correction").alias("correction"), F.trim("reason").alias("reason"), "target_section_id", "target_section_hash", *lists, "thread_id", F.lit(now).alias("created_at")
    )


# -- lists and pages ---------------------------------------------------------------------------------------------


def latest(rows: DataFrame, date: str, ties: list[str], k: int) -> DataFrame:
    return rows.orderBy(F.desc(date), *ties).limit(k)


def entity_pages(facts: DataFrame, entity: str, date: str, fact_id: str, k: int = RECENT) -> DataFrame:
    """The latest ``k`` facts of each entity with their rank."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(date), fact_id))
    return facts.withColumn("rank", rank).where(F.col("rank") <= k)


def view_manifest(pages: DataFrame, entity: str, fact_id: str) -> DataFrame:
    """(view, fact_count, depends_on) of entity pages."""
    return pages.groupBy(entity).agg(F.count("*").alias("fact_count"), F.array_join(F.array_sort(F.collect_set(F.col(fact_id).cast("string"))), ",").alias("depends_on")).withColumn("view", F.concat(F.lit("entity:"), F.col(entity).cast("string")))


def page_facts(facts: DataFrame, touched: DataFrame, index: DataFrame) -> DataFrame:
    """(entity_id, fact_id) of each viewed entity's facts: those about it, through any of their ends.

    ``touched``: fact_id, entity_id, the entities that facts name.
    """
    ends = facts.select("fact_id", F.explode(F.array("subject_id", "primary_entity_id", "from_entity_id", "to_entity_id")).alias("entity_id")).where("entity_id IS NOT NULL")
    viewed = index.where(is_viewed(F.col("entity_type"))).select("entity_id")
    return ends.unionByName(touched.select("fact_id", "entity_id")).distinct().join(viewed, "entity_id", "left_semi").select("entity_id", "fact_id")


def page_dependencies(own: DataFrame, touched: DataFrame, property_id: str) -> DataFrame:
    """(view, kind, id): what each entity's page depends on, facts and entities, a row each."""
    view = F.concat(F.lit(f"contexts/{property_id}/entities/"), file_stem(F.col("entity_id")), F.lit(".md")).alias("view")
    facts = own.select(view, F.lit("fact").alias("kind"), F.col("fact_id").alias("id"))
    named = own.join(touched.select("fact_id", F.col("entity_id").alias("other")), "fact_id").select(view, F.lit("entity").alias("kind"), F.col("other").alias("id"))
    itself = own.select(view, F.lit("entity").alias("kind"), F.col("entity_id").alias("id"))
    return facts.unionByName(named).unionByName(itself).distinct()


def entity_documents(index: DataFrame, facts: DataFrame, sources: DataFrame, touched: DataFrame, evidence: DataFrame, property_id: str, now: str) -> DataFrame:
    """(entity_id, view, text): the page of each viewed entity: profile, fields, relations, active and recent facts.

    Only the facts that a page shows are gathered for it.
    """
    viewed = index.where(is_viewed(F.col("entity_type")))
    date = F.coalesce("event_date", "due_date", "valid_from", F.lit(""))
    dated = facts.select("fact_id", "kind", date.alias("date"), epoch_millis(date).alias("millis"), "decision", "statement")
    own = page_facts(facts, touched, index).join(dated, "fact_id")
    is_active = F.col("kind").isin(*ACTIVE_KINDS) | (F.col("decision") != "keep")

    def first(rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("millis"), "fact_id"))).where(F.col("rank") <= k)

    shown = first(own, RECENT).withColumn("part", F.lit("recent")).unionByName(first(own.where(is_active), ACTIVE).withColumn("part", F.lit("active")))
    wanted = shown.select("fact_id").distinct()
    refs = first_values(sources.join(wanted, "fact_id", "left_semi"), "fact_id", "source_id", SOURCES_SHOWN).select("fact_id", source_reference(F.col("values")).alias("ref"))
    quotes = evidence.where("evidence.quote <> ''").join(wanted, "fact_id", "left_semi").groupBy("fact_id").agg(first_quote(F.array(F.min_by("evidence", "place")), PAGE_QUOTE).alias("quote"))
    full = shown.join(refs, "fact_id", "left").join(quotes, "fact_id", "left")
    ref, quote = F.coalesce("ref", F.lit("")), F.coalesce("quote", F.lit(""))
    cells = F.when(F.col("part") == "active", F.array("fact_id", "kind", "date", "decision", "statement", ref)).otherwise(F.array("fact_id", "kind", "date", "statement", quote, ref))
    listed = full.groupBy("entity_id").pivot("part", ["active", "recent"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cells.alias("cells")))), lambda x: x["cells"]))
    related = related_entities(index).join(viewed.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("type", "related_id", "name"))), lambda x: F.array(x["related_id"], x["type"], x["name"])).alias("related_rows"))
    fields = F.transform(F.map_entries("fields"), lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit(""))))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Entity Context: "), "entity_id"), F.lit(f"\nGenerated: {now}\n\n{PAGE_NOTE}\n\n## Profile\n"), F.concat(F.lit("- ID: "), "entity_id"), F.concat(F.lit("- Type: "), "entity_type"), F.concat(F.lit("- Name: "), "name"),
        F.lit(f"- Property: {property_id}\n\n## Canonical Fields\n"), markdown_table(["Field", "Value"], fields), F.lit("\n## Related Entities\n"), markdown_table(["ID", "Type", "Name"], F.col("related_rows")),
        F.lit("\n## Active / Needs Review\n"), markdown_table(["Fact", "Kind", "Date", "Decision", "Statement", "Sources"], F.col("active")), F.lit("\n## Related Facts\n"), markdown_table(["Fact", "Kind", "Date", "Statement", "Evidence", "Sources"], F.col("recent")), F.lit(""),
    )
    joined = viewed.join(listed, "entity_id", "left").join(related, "entity_id", "left")
    return joined.select("entity_id", F.concat(F.lit(f"contexts/{property_id}/entities/"), file_stem(F.col("entity_id")), F.lit(".md")).alias("view"), text.alias("text"))


def financial_totals(payments: DataFrame, amount: str, date: str) -> DataFrame:
    """One row: number, inflow, outflow, first and last date."""
    return payments.agg(
        F.count("*").alias("payments"),
        F.sum(F.when(F.col(amount) > 0, F.col(amount)).otherwise(0)).cast("double").alias("inflow"),
        F.sum(F.when(F.col(amount) < 0, F.col(amount)).otherwise(0)).cast("double").alias("outflow"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
    )


def top_categories(rows: DataFrame, category: str, k: int = 10) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category).limit(k)


def views_read(documents: DataFrame, key: str, wanted: str, text: str) -> DataFrame:
    """(text) of the view of one name; none if there is no such view."""
    return documents.where(F.col(key) == wanted).select(F.coalesce(missing_if_blank(F.col(text)), F.lit("")).alias("text"))

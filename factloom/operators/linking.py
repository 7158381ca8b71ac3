"""Links from sources to entities: declared ids, mentions, contained aliases, and what these relate to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.rounds import cut, numbered

# Types of aliases that aren't searched for, those that count at any length, the length of others, types
# that don't decide a link, how many code units of a text are searched, how many candidates a reader is shown.
UNSEARCHED, SHORT_ALLOWED, LEAST_LENGTH = ("id", "filename"), ("email", "iban"), 5
WEAK_TYPES = ("property", "email", "letter")
SEARCHED_TEXT, MOST_CANDIDATES = 60_000, 40
# End of fixed values.

CANDIDATE = ["source_id", "entity_id", "match_type", "inherited_from", "evidence"]
#: Edges of a graph's cycles that one task solves (about 200 MB there); more are solved by rounds of joins.
ONE_TASK = 500_000
#: Characters of all terms that one automaton holds, which takes up to 190 MB of a worker (measured with 258046 terms that
#: share little); more terms are dealt over several automata, each of which scans the texts.
TERM_CHARACTERS = 4_000_000

#: Rows that one task sorts or groups when sources meet nodes; rows of one key, beyond which what they meet is broadcast, and
#: rows of a broadcast (some 60 MB).
TASK_ROWS, HOT_ROWS, HOT_OTHERS = 300_000, 100_000, 300_000


def mention_links(mentions: DataFrame, index: DataFrame, match_type: str) -> DataFrame:
    """Candidates for named ids (source_id, entity_id) that are entities."""
    found = mentions.distinct().join(index.select("entity_id"), "entity_id", "left_semi")
    return found.select("source_id", "entity_id", F.lit(match_type).alias("match_type"), F.lit(None).cast("string").alias("inherited_from"), F.col("entity_id").alias("evidence"))


def property_scope(sources: DataFrame, property_id: str) -> DataFrame:
    """The candidate that every source has: the property."""
    return sources.select("source_id", F.lit(property_id).alias("entity_id"), F.lit("property_scope").alias("match_type"), F.lit(None).cast("string").alias("inherited_from"), F.lit(property_id).alias("evidence"))


def contained(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str, seen: tuple | None = None) -> DataFrame:
    """Pairs (id, term) of a text and each term that stands in it anywhere, each once.

    One scan of the texts, whatever the number of terms: the distinct terms are broadcast as an automaton that finds
    all of them at once.  Their size is checked; past TERM_CHARACTERS they are dealt over several automata by hash,
    one scan each.  No text is ever shuffled.  Null and empty texts and terms give nothing.  ``seen``: an Observation
    and an aggregate that it takes of the texts of the first scan.
    """
    spark = texts.sparkSession
    distinct = terms.where(F.col(term_col).isNotNull() & (F.col(term_col) != "")).select(term_col).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length(term_col)), F.lit(0))).first()[0]
    shards = size // TERM_CHARACTERS + 1
    kind = texts.schema[id_col].dataType.simpleString()
    found = None
    for shard in range(shards):
        words = distinct.where(F.pmod(F.xxhash64(term_col), F.lit(shards)) == shard).toArrow().column(0).to_pylist()
        shared = spark.sparkContext.broadcast(sorted(words))

        def run(batches, shared=shared):
            import ahocorasick
            import pyarrow as pa

            automaton = ahocorasick.Automaton()
            for word in shared.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                ids, hits = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = {word for _, word in automaton.iter(text)} if text and shared.value else ()
                    ids += [key] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(0).type), pa.array(hits, type=pa.string())], names=[id_col, term_col])

        scanned = texts.select(id_col, text_col)
        if seen is not None and shard == 0:
            scanned = scanned.observe(*seen)
        part = scanned.mapInArrow(run, f"`{id_col}` {kind}, `{term_col}` string")
        found = part if found is None else found.unionByName(part)
    return found


def searched_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases (alias, folded, entity_id, alias_type) that are looked for: mail addresses and IBANs of any length, others from LEAST_LENGTH on."""
    long_enough = F.col("alias_type").isin(*SHORT_ALLOWED) | (F.length("folded") >= LEAST_LENGTH)
    return aliases.where(~F.col("alias_type").isin(*UNSEARCHED) & (F.col("folded") != "") & long_enough)


def alias_links(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidates for aliases that stand in a source's folded text (source_id, text).

    ``aliases``: alias (the evidence), folded, entity_id, alias_type.
    """
    usable = searched_aliases(aliases)
    return links_of_hits(contained(texts, usable, "source_id", "text", "folded"), usable)


def links_of_hits(hits: DataFrame, usable: DataFrame) -> DataFrame:
    """Candidates of the aliases (alias, folded, entity_id, alias_type) whose folded forms stand in texts (source_id, folded)."""
    hits = hits.join(usable, "folded")
    kind = F.when(F.col("alias_type") == "email", "email").otherwise("alias")
    return hits.select("source_id", "entity_id", kind.alias("match_type"), F.lit(None).cast("string").alias("inherited_from"), F.col("alias").alias("evidence")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of a directed graph (from_id, to_id) that lie on a cycle; the smallest id names it.

    Edges that can't lie on a cycle are trimmed first, which leaves little of a hierarchy.  Then each node takes the
    smallest id that reaches it, and those that reach this id within the same label are its component; what is left is
    done again, up to what one task solves at once (ONE_TASK edges).  Nulls and loops are dropped.
    """
    found = None
    left, size = _trimmed(edges.select("from_id", "to_id").where("from_id <> to_id").distinct())
    while size:
        if size <= ONE_TASK:
            few = left.coalesce(1).mapInPandas(_solve, "node string, label string")
            found = few if found is None else found.unionByName(few)
            break
        label = _labels(left)
        same = left.join(label.select(F.col("node").alias("from_id"), "label"), "from_id").join(label.select(F.col("node").alias("to_id"), F.col("label").alias("_to")), "to_id").where("label = _to").select("from_id", "to_id")
        front = cut(label.where("node = label"))
        member = front
        while not front.isEmpty():
            back = front.withColumnRenamed("node", "to_id").join(same, "to_id").select(F.col("from_id").alias("node"), "label").distinct()
            front = cut(back.join(member.select("node"), "node", "left_anti"))
            member = member.unionByName(front)
        member = cut(member)
        found = member if found is None else found.unionByName(member)
        gone = member.select("node")
        left, size = _trimmed(left.join(gone.withColumnRenamed("node", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("node", "to_id"), "to_id", "left_anti"))
    nothing = edges.select(F.col("from_id").alias("node"), F.col("from_id").alias("component")).limit(0)
    return nothing if found is None else found.withColumnRenamed("label", "component").groupBy("node").agg(F.min("component").alias("component"))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have both an edge in and an edge out, until all or few enough are so, and their number."""
    edges, before = cut(edges), None
    while (size := edges.count()) and size != before and size > (ONE_TASK if before is not None else 0):
        ends, heads = edges.select(F.col("to_id").alias("from_id")).distinct(), edges.select(F.col("from_id").alias("to_id")).distinct()
        edges, before = cut(edges.join(ends, "from_id", "left_semi").join(heads, "to_id", "left_semi").select("from_id", "to_id")), size
    return edges, size


def _solve(batches):
    """(node, label) of the cycles among all edges of the batches: by depth, without recursion."""
    import pandas as pd

    after: dict[str, list[str]] = {}
    for rows in batches:
        for a, b in zip(rows["from_id"], rows["to_id"], strict=True):
            after.setdefault(a, []).append(b)
    order, low, open_, path, found = {}, {}, set(), [], []
    for start in after:
        if start in order:
            continue
        walk = [(start, iter(after[start]))]
        order[start] = low[start] = len(order)
        path.append(start)
        open_.add(start)
        while walk:
            node, rest = walk[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    path.append(other)
                    open_.add(other)
                    walk.append((other, iter(after.get(other, ()))))
                    break
                if other in open_:
                    low[node] = min(low[node], order[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    cycle = [path.pop()]
                    while cycle[-1] != node:
                        cycle.append(path.pop())
                    open_.difference_update(cycle)
                    if len(cycle) > 1:
                        found += [(x, min(cycle)) for x in cycle]
    yield pd.DataFrame(found, columns=["node", "label"]).astype("object")


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that reaches each, itself included."""
    nodes = edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")).distinct()
    label = cut(nodes.withColumn("label", F.col("node")))
    front = label
    while not front.isEmpty():
        told = edges.join(front.withColumnRenamed("node", "from_id"), "from_id").groupBy(F.col("to_id").alias("node")).agg(F.min("label").alias("_new"))
        better = label.join(told, "node", "left").select("node", F.least("label", "_new").alias("label"), F.coalesce(F.col("_new") < F.col("label"), F.lit(False)).alias("_moved"))
        better = cut(better)
        front, label = better.where("_moved").drop("_moved"), better.drop("_moved")
    return label


def _later(a: str, b: str) -> Column:
    return F.greatest(a, b)  # nulls, open ends, are skipped


def reach(roots: DataFrame, steps: DataFrame, gates: DataFrame) -> DataFrame:
    """(root, node, since, until): the nodes that each root comes to, and when it may be walked on from there.

    ``roots``: root; ``steps``: a, b; ``gates``: node, since, until, of which a node may have several; a node without
    any is always open.  Ends that are null are open.  A row that another one covers isn't walked again, so cycles end.
    Rows whose time is empty are kept: walks of unknown time take them.
    """
    gated = lambda rows: rows.join(gates.withColumnsRenamed({"since": "_since", "until": "_until"}), "node", "left").select("root", "node", _later("since", "_since").alias("since"), F.least("until", "_until").alias("until")).distinct()
    none = F.lit(None).cast("date")
    front = cut(gated(roots.select("root", F.col("root").alias("node"), none.alias("since"), none.alias("until"))))
    known = front
    while True:
        walked = front.withColumnRenamed("node", "a").join(steps, "a").select("root", F.col("b").alias("node"), "since", "until")
        fresh, old = gated(walked).alias("f"), known.alias("k")
        covered = (F.col("f.root") == F.col("k.root")) & (F.col("f.node") == F.col("k.node")) & (F.col("k.since").isNull() | (F.col("k.since") <= F.col("f.since"))) & (F.col("k.until").isNull() | (F.col("k.until") >= F.col("f.until")))
        front = cut(fresh.join(old, covered, "left_anti"))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front))


class Reached(NamedTuple):
    """What sources come to, not yet spread over them: see ``reached``."""

    own: DataFrame
    table: DataFrame
    walks: DataFrame
    tasks: int
    hot: DataFrame


def reached(direct: DataFrame, edges: DataFrame, gated: DataFrame | None = None) -> Reached:
    """The sources' nodes (own: source_id, day, root), what each node comes to (table: root, node, since, until) and the
    edges from there (walks: a, from_id, to_id), for ``expand``, ``item_relations`` and ``relation_records``.

    Nothing is walked for a single source: entities on one cycle are made one node, and what each node comes to, and when,
    is worked out once.  ``tasks``: so many that none holds more than TASK_ROWS sources' nodes; ``hot``: nodes of many.
    """
    spark = direct.sparkSession
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    gates = spark.createDataFrame([], "node string, since date, until date") if gated is None else gated.select(F.col("entity_id").alias("node"), day(F.col("valid_from")).alias("since"), day(F.col("valid_to")).alias("until")).distinct()
    gates = gates if gated is None else cut(gates)
    edges = cut(edges.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    shut = gates.select("node").distinct()
    plain = edges.join(shut.withColumnRenamed("node", "from_id"), "from_id", "left_anti").join(shut.withColumnRenamed("node", "to_id"), "to_id", "left_anti")
    cycles = cut(strong_components(plain))
    merged = lambda rows, c: rows.join(cycles.withColumnsRenamed({"node": c, "component": "_c"}), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    walks = cut(merged(edges.withColumn("a", F.col("from_id")), "a"))
    steps = merged(walks.select("a", F.col("to_id").alias("b")), "b").where("a <> b").distinct()
    own = cut(merged(direct.select("source_id", day(F.col("day")).alias("day"), F.col("entity_id").alias("root")), "root"))
    tasks = max(spark.sparkContext.defaultParallelism, own.count() // TASK_ROWS + 1)
    roots = cut(own.groupBy("root").count())
    table = reach(roots.select("root"), cut(steps), gates)
    return Reached(own, table, walks, tasks, roots.where(F.col("count") > HOT_ROWS).select("root"))


def beside(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame, tasks: int | None = None) -> DataFrame:
    """``rows`` joined with ``other`` by ``key``: neither rows of a key in ``hot`` nor sorts of large tasks stand in one task.

    What ``other`` has for the hot keys is broadcast, HOT_OTHERS of its rows at a time; the rest is shuffled.
    """
    keys = F.broadcast(hot.select(key))
    many, few = cut(other.join(keys, key, "left_semi")), other.join(keys, key, "left_anti")
    dealt = lambda df: df if tasks is None else df.repartition(tasks, key)
    found = dealt(rows.join(keys, key, "left_anti")).join(dealt(few), key)
    shards = -(-many.count() // HOT_OTHERS)
    for shard in range(shards):
        part = many if shards == 1 else many.where(F.pmod(F.xxhash64(*many.columns), F.lit(shards)) == shard)
        found = found.unionByName(rows.join(F.broadcast(part), key))
    return found


def _met(r: Reached, told: DataFrame | None = None) -> DataFrame:
    """(source_id, a): the nodes that each source comes to, each once, dealt by source_id; with ``told``'s (a, ...) of them."""
    table = r.table if told is None else r.table.join(told.withColumnRenamed("a", "node"), "node", "left")
    more = [] if told is None else [c for c in told.columns if c != "a"]
    met = beside(r.own, table, "root", r.hot, r.tasks).where("day IS NULL OR ((since IS NULL OR day >= since) AND (until IS NULL OR day <= until))")
    return met.select("source_id", F.col("node").alias("a"), *more).repartition(2 * r.tasks, "source_id").distinct()


def _walked(rows: DataFrame, walks: DataFrame) -> DataFrame:
    """``rows`` (a, ...) with each edge that leaves their nodes."""
    rows = cut(rows)
    hot = cut(rows.groupBy("a").count().where(F.col("count") > HOT_ROWS))
    return beside(rows, walks, "a", hot, max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS + 1))


def expand(direct: DataFrame, edges: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Candidates for everything the direct ones relate to, until nothing is new.

    ``direct``: source_id, entity_id and day; ``edges``: from_id, to_id.  Every edge walked is a candidate.  ``gated``
    (entity_id, valid_from, valid_to) are entities, tenants, from which nothing is walked on days out of their range.
    """
    r = reached(direct, edges, gated)
    return _walked(_met(r), r.walks).select("source_id", F.col("to_id").alias("entity_id"), F.lit("relationship").alias("match_type"), F.col("from_id").alias("inherited_from"), _evidence())


def _evidence() -> Column:
    return F.concat_ws(" -> ", "from_id", "to_id").alias("evidence")


def item_relations(items: DataFrame, r: Reached) -> DataFrame:
    """``item_candidates`` of ``expand``'s candidates, which are not written out for it.

    An edge leaves one node, so the sources are counted by item and node, and edges joined to these counts.
    """
    own = items.select("work_item_id", "source_id").repartition(2 * r.tasks, "source_id").distinct()
    counted = own.join(_met(r), "source_id").groupBy("work_item_id", "a").agg(F.count("*").alias("sources"))
    return _walked(counted, r.walks).select("work_item_id", F.col("to_id").alias("entity_id"), F.lit("work_item_aggregate").alias("match_type"), F.col("from_id").alias("inherited_from"), _evidence(), "sources")


def relation_records(sources: DataFrame, r: Reached, index: DataFrame, property_id: str | None = None) -> DataFrame:
    """``link_records`` of ``expand``'s candidates, which are not written out for it: each node tells what its edges lead to."""
    typed = r.walks.join(index.select(F.col("entity_id").alias("to_id"), "entity_type"), "to_id")
    told = typed.groupBy("a").agg(*_kinds("to_id", property_id))
    kinds = _met(r, told).groupBy("source_id").agg(F.max("strong").alias("strong"), F.sum("typed").alias("typed"), F.sum("candidate_count").alias("candidate_count"), F.max("scoped").alias("scoped"))
    return _records(sources, kinds.where("candidate_count > 0"), "source_id", property_id, 2 * r.tasks)


def building_edges(index: DataFrame, property_id: str) -> DataFrame:
    """(from_id, to_id) from every building to the property, whether the index relates them or not."""
    return index.where((F.col("entity_type") == "building") & (F.col("entity_id") != property_id)).select(F.col("entity_id").alias("from_id"), F.lit(property_id).alias("to_id"))


def tenancies(index: DataFrame) -> DataFrame:
    """(entity_id, valid_from, valid_to) of tenants."""
    f = lambda c: F.nullif(F.trim(F.col("fields")[c]), F.lit(""))
    return index.where("entity_type = 'tenant'").select("entity_id", f("mietbeginn").alias("valid_from"), f("mietende").alias("valid_to"))


def _kinds(entity: str, property_id: str | None) -> list[Column]:
    """Of candidates with their entity_type: whether any type decides, how many have one, how many there are, whether one is the property."""
    own = F.lit(None).cast("boolean") if property_id is None else F.col(entity) == property_id
    return [F.max(~F.col("entity_type").isin(*WEAK_TYPES)).alias("strong"), F.count("entity_type").alias("typed"), F.count("*").alias("candidate_count"), F.max(own).alias("scoped")]


def _records(sources: DataFrame, kinds: DataFrame, target: str, property_id: str | None, tasks: int | None = None) -> DataFrame:
    """linked if any candidate's type decides; property_only if the property is a candidate; else unlinked."""
    scoped = F.col("typed") > 0 if property_id is None else F.col("scoped")
    decision = F.when(F.col("strong"), "linked").when(scoped, "property_only").otherwise("unlinked")
    own = sources.select(target)
    own = own if tasks is None else own.repartition(tasks, target)
    return own.join(kinds, target, "left").select(target, decision.alias("decision"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))


def last_candidates(candidates: DataFrame, target: str, order: Column) -> DataFrame:
    """Of candidates that agree in target, entity, match type, origin and evidence, the last in ``order``."""
    key = [target, "entity_id", "match_type", "inherited_from", "evidence"]
    others = [c for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.max_by(F.struct(*(others or key)), order).alias("_last"))
    return best.select(*key, *[F.col(f"_last.{c}").alias(c) for c in others])


def link_records(sources: DataFrame, candidates: DataFrame, index: DataFrame, target: str = "source_id", property_id: str | None = None) -> DataFrame:
    """(target, decision, candidate_count) of every source, or of another ``target``; candidates that aren't entities don't count."""
    named = candidates.select(target, "entity_id")
    hot = cut(named.groupBy("entity_id").count().where(F.col("count") > HOT_ROWS))
    kinds = beside(named, index.select("entity_id", "entity_type"), "entity_id", hot).groupBy(target).agg(*_kinds("entity_id", property_id))
    return _records(sources, kinds, target, property_id)


def link_summary(records: DataFrame) -> DataFrame:
    """Sources per decision; nothing is ever ambiguous, which has a count of 0."""
    return records.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("linked", "property_only", "unlinked", "ambiguous")])


def item_candidates(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(work_item_id, entity_id, match_type, inherited_from, evidence, sources): candidates of work items (work_item_id, source_id).

    What the item's sources share is one candidate, with the number of sources and the first one's evidence.
    """
    joined = items.join(candidates, "source_id")
    kind = F.when(F.col("match_type") == "property_scope", F.col("match_type")).otherwise("work_item_aggregate")
    grouped = joined.groupBy("work_item_id", "entity_id", "match_type", "inherited_from").agg(F.countDistinct("source_id").alias("sources"), F.min(F.struct("source_id", "evidence")).alias("first"))
    return grouped.select("work_item_id", "entity_id", kind.alias("match_type"), "inherited_from", "first.evidence", "sources")


def ordered_candidates(candidates: DataFrame, index: DataFrame, target: str = "source_id") -> DataFrame:
    """Candidates that are entities, with ``place``: their order over all targets, then by entity type, entity and match
    type as Unicode collates them, then by origin and evidence."""
    named = candidates.join(index.select("entity_id", "entity_type"), "entity_id")
    collated = [F.collate(c, "UNICODE") for c in (F.col(target), F.concat_ws(":", "entity_type", "entity_id", "match_type"))]
    return numbered(named, [*collated, F.coalesce("inherited_from", F.lit("")), F.coalesce("evidence", F.lit(""))])


def ordered_records(records: DataFrame) -> DataFrame:
    """Records of ``union_records`` with ``place``: their order by type and id of the target, as Unicode collates them."""
    return numbered(records, [F.collate(F.concat_ws(":", "target_type", "target_id"), "UNICODE"), F.col("target_id")])


def union_records(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Records of sources and of work items together: (target_type, target_id, decision, candidate_count)."""
    one = lambda rows, kind, key: rows.select(F.lit(kind).alias("target_type"), F.col(key).alias("target_id"), "decision", "candidate_count")
    return one(sources, "source", "source_id").unionByName(one(items, "work_item", "work_item_id"))


def searched_text(path: Column, source_date: Column, declared: Column, text: Column) -> Column:
    """What is searched for a source's links: its path, date and declared ids, then its text, cut to SEARCHED_TEXT."""
    return F.substring(F.concat_ws("\n", path, F.coalesce(source_date, F.lit("")), F.nullif(F.array_join(declared, "\n"), F.lit("")), text), 1, SEARCHED_TEXT)

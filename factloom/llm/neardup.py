"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours.

Vectors with equal values are one node.  A node's sketch is the sides of BITS random hyperplanes that it lies on.

1. Each node's first list of neighbours holds the nearest of those next to it in several orders of the sketches, however
   far they are.  In each round every node brings its neighbours, and those it is a neighbour of, together; they are
   compared by their sketches, and lists keep the nearest.  Rounds go on while lists get better.
2. A list whose last neighbour may still be a link is saturated: it is enlarged to twice its length, up to LONGEST, and the
   rounds go on.
3. Only then are neighbours that may be links compared as vectors; the threshold keeps its edges.
4. Groups that the longest lists can't hold: every node meets the neighbours of its neighbours in cells, named by the
   smallest node within two steps, whose members are compared in blocks, until no link is new.
5. An audit compares a fixed number of nodes, drawn without regard to links, with all others, and as many linked ones.  If
   it finds a link that the graph lacks, a graph from other hyperplanes is added, up to BATCHES times; should the audit
   still find one then, all nodes of each label are compared in blocks.  The recall that the audit found is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, components

#: Hyperplanes, orders of their sides, and how many nodes next to it in each order a node is compared with.
BITS, ORDERS, NEXT = 256, 16, 8
#: Length of the first lists and of the longest ones; neighbours of others that a node brings along.
SHORTEST, LONGEST, REVERSE = 8, 32, 16
#: Rounds end when under this share of the lists' places changes.
SETTLED = 0.05
#: Deviations over the mean of a threshold pair up to which sketches may be links.
DEVIATIONS = 5
#: Vectors per block of a cell, nodes of the audit, graphs made before all nodes are compared.
BLOCK, AUDIT, BATCHES = 1024, 256, 4
LISTS = "id long, other long, apart int"
LINKS = "id long, other array<long>"


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vec) of every row: the vector's numbers as bytes, and a 128-bit digest of these.

    Both are null for a vector that links with nothing: null, empty, zero, or with a null or non-finite entry.
    Bytes, unlike lists, pass through shuffles and aggregates without being taken apart.
    """
    kind = number_kind(vectors, vector_col)
    spark_kind = "float" if kind == "<f4" else "double"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from xxhash import xxh3_128_digest

        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(b.column(2).flatten(), float("nan")).to_numpy(zero_copy_only=False)
            flat = flat.astype(kind) + np.zeros(1, dtype=kind)  # so that -0.0 is written as 0.0
            end = np.cumsum(size)
            count = lambda x: np.r_[0, np.cumsum(x)][end] - np.r_[0, np.cumsum(x)][end - size]
            good = ((count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)).tolist()
            raw, width = flat.tobytes(), flat.itemsize
            vec = [raw[(e - n) * width : e * width] if g else None for e, n, g in zip(end.tolist(), size.tolist(), good, strict=True)]
            key = [None if v is None else xxh3_128_digest(v) for v in vec]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, type=pa.binary()), pa.array(vec, type=pa.binary())], names=["id", "label", "key", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{spark_kind}>").alias("v"))
    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, key binary, vec binary")


def number_kind(vectors: DataFrame, vector_col: str) -> str:
    """How a vector's numbers are written: as they are, so that cosines in double precision see their exact values."""
    return "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def nodes(rows: DataFrame) -> DataFrame:
    """(id, label, key, vec, copies): one row per label and value of ``packed`` rows, under its smallest id.

    Without rows whose label or id is null, or whose vector links with nothing.
    """
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    return good.groupBy("label", "key", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "label", "key", "vec", "copies")


def _unit(column, kind: str):
    """A matrix of unit rows from equally long vectors; scaled first, so that squares neither overflow nor vanish."""
    import numpy as np

    matrix = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(float)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _by_width(table):
    """Parts of ``table`` whose vectors are equally long: only those can link."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    widths = pc.binary_length(table.column("vec")).to_numpy()
    for width in np.unique(widths):
        yield table.filter(pa.array(widths == width)).combine_chunks()


def _close(x, y, least: float):
    """Places of row pairs with cosine >= least.  Near the threshold the product is summed afresh pair by pair."""
    import numpy as np

    cosine = x @ y.T
    sure, near = cosine >= least + 1e-12, np.abs(cosine - least) < 1e-12
    if near.any():
        a, b = np.nonzero(near)
        sure[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= least
    return sure


def _lists(ids, hits):
    """(id, other) batches from (places, places) pairs, both ways; one row per id."""
    import numpy as np
    import pyarrow as pa

    if not any(len(a) for a, _ in hits):
        return
    a, b = (np.concatenate(x) for x in zip(*hits, strict=True))
    a, b = np.r_[ids[a], ids[b]], np.r_[ids[b], ids[a]]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b = a[fresh], b[fresh]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    other = pa.ListArray.from_arrays(pa.array(np.r_[first, len(a)].astype(np.int32)), pa.array(b))
    yield pa.RecordBatch.from_arrays([pa.array(a[first]), other], names=["id", "other"])


def sketches(all_nodes: DataFrame, kind: str, batch: int) -> DataFrame:
    """(id, label, sketch) of each node: BITS sides of hyperplanes that ``batch`` and the vector's length draw."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part in _by_width(pa.Table.from_batches([b])):
                unit = _unit(part.column("vec").chunk(0), kind)
                planes = np.random.default_rng([batch, unit.shape[1]]).normal(size=(unit.shape[1], BITS))
                sides = np.packbits(unit @ planes > 0, axis=1)
                yield from part.select(["id", "label"]).append_column("sketch", pa.array([x.tobytes() for x in sides], type=pa.binary())).to_batches()

    return all_nodes.select("id", "label", "vec").mapInArrow(sign, f"id long, label {all_nodes.schema['label'].dataType.simpleString()}, sketch binary")


def _bits(column):
    """A matrix of 64-bit words from a column of sketches."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def first_lists(known: DataFrame) -> DataFrame:
    """LISTS of each node and the NEXT nodes of its label on either side, in each of ORDERS orders of the sketches."""
    step = BITS // 8 // ORDERS
    turned = F.array(*[F.struct(F.lit(n).alias("order"), F.concat(F.expr(f"substring(sketch, {n * step + 1})"), F.expr(f"substring(sketch, 1, {n * step})")).alias("key")) for n in range(ORDERS)])
    each = known.select("id", "label", "sketch", F.explode(turned).alias("t")).select("t.order", "label", F.expr("substring(t.key, 1, 8)").alias("key"), "id", "sketch")
    # The order, not a bucket, is dealt out, so that many alike nodes still spread over tasks.
    ordered = each.repartitionByRange("order", "label", "key").sortWithinPartitions("order", "label", "key", "id")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = t.slice(max(0, t.num_rows - NEXT))
            ids, order, bits = t.column("id").to_numpy(), t.column("order").to_numpy(), _bits(t.column("sketch"))
            label = np.unique(t.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            for n in range(1, min(NEXT, t.num_rows - 1) + 1):
                at = np.flatnonzero((label[:-n] == label[n:]) & (order[:-n] == order[n:]))
                apart = np.bitwise_count(bits[at] ^ bits[at + n]).sum(axis=1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[at], ids[at + n]]), pa.array(np.r_[ids[at + n], ids[at]]), pa.array(np.r_[apart, apart])], names=["id", "other", "apart"])

    return ordered.mapInArrow(compare, LISTS).where("id <> other")


def nearest(lists: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nearest of each node's neighbours, as many as its length says, each once."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("apart", "other"))
    kept = lists.distinct().withColumn("rank", rank).where(F.col("rank") <= LONGEST)
    return kept.join(lengths, "id").where(F.col("rank") <= F.col("length")).select("id", "other", "apart")


def met(lists: DataFrame, known: DataFrame, lengths: DataFrame) -> DataFrame:
    """LISTS made by comparing with each other what each node brings along: its neighbours and some that have it as one.

    Pairs that are in neither one's list yet, and nearer than what either one's list ends with, are returned.
    """
    drawn = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "other")))
    back = lists.select(F.col("other").alias("id"), F.col("id").alias("other")).withColumn("rank", drawn).where(F.col("rank") <= REVERSE).select("id", "other")
    brought = lists.select("id", "other").unionByName(back).distinct()
    ends = lists.groupBy("id").agg(F.count("*").alias("n"), F.max("apart").alias("last")).join(lengths, "id").select(F.col("id").alias("other"), F.when(F.col("n") < F.col("length"), BITS + 1).otherwise(F.col("last")).cast("int").alias("end"))
    full = brought.join(known.select(F.col("id").alias("other"), "sketch"), "other").join(ends, "other")
    dealt = full.select("id", "other", "sketch", "end").repartition("id").sortWithinPartitions("id")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def group(t):
            ids, end, bits = t.column("other").to_numpy(), t.column("end").to_numpy(), _bits(t.column("sketch"))
            apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int32)
            x, y = np.nonzero((apart < end[:, None]) & (ids[:, None] != ids[None]))
            return ids[x], ids[y], apart[x, y]

        def told(found):
            if found:
                x, y, z = (np.concatenate(v) for v in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z)], names=["id", "other", "apart"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, begin, found = t.column("id").to_numpy(), 0, []
            for end in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
                found.append(group(t.slice(begin, end - begin)))
                begin = end
            held = t.slice(begin)
            yield from told(found)
        if held is not None and held.num_rows:
            yield from told([group(held)])

    return dealt.mapInArrow(compare, LISTS)


def descend(known: DataFrame, most: int) -> DataFrame:
    """The lists of all nodes when rounds no longer change them; those that end within ``most`` bits are enlarged."""
    lengths = checkpoint(known.select("id", F.lit(SHORTEST).alias("length")))
    lists = checkpoint(nearest(first_lists(known), lengths))
    places = lists.count()
    while places:
        better = checkpoint(nearest(lists.unionByName(met(lists, known, lengths)), lengths))
        same = better.join(lists.select("id", "other", F.lit(1).alias("same")), ["id", "other"], "left")
        places, kept = same.agg(F.count("*"), F.count("same")).first()
        lists = better
        if places - kept > SETTLED * places:
            continue
        full = lists.groupBy("id").agg(F.count("*").alias("n"), F.max("apart").alias("last")).where(F.col("last") <= most)
        longer = checkpoint(lengths.join(full, "id", "left").select("id", F.when((F.col("n") >= F.col("length")) & (F.col("length") < LONGEST), 2 * F.col("length")).otherwise(F.col("length")).cast("int").alias("length"), "length").toDF("id", "length", "before"))
        if longer.where("length <> before").isEmpty():
            break
        lengths = longer.select("id", "length")
    return lists


def threshold_edges(lists: DataFrame, all_nodes: DataFrame, kind: str, least: float, most: int) -> DataFrame:
    """LINKS: neighbours within ``most`` bits whose cosine is ``least`` or more."""
    pairs = lists.where(F.col("apart") <= most).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    vec = lambda c: all_nodes.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}"))
    full = pairs.join(vec("a"), "a").join(vec("b"), "b").where(F.length("vec_a") == F.length("vec_b")).select("a", "b", "vec_a", "vec_b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).rename_columns(["a", "b", "vec", "other"])
            for part in _by_width(t):
                x, y = _unit(part.column("vec").chunk(0), kind), _unit(part.column("other").chunk(0), kind)
                good = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= least)
                a, b = part.column("a").to_numpy()[good], part.column("b").to_numpy()[good]
                yield from _lists(np.r_[a, b], [(np.arange(len(a)), np.arange(len(a)) + len(a))] if len(a) else [])

    return full.mapInArrow(run, LINKS)


def most_bits(least: float) -> int:
    """Bits that sketches of vectors with cosine ``least`` hardly ever exceed."""
    from math import acos, ceil, pi, sqrt

    share = acos(max(-1.0, min(1.0, least))) / pi
    return ceil(BITS * share + DEVIATIONS * sqrt(BITS * share * (1 - share)))


def merge(*links: DataFrame) -> DataFrame:
    """One list per id: the distinct others."""
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("other")))).alias("other"))


def twins(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, twin, low) of each node, and (twin, other) of each group with one and the same closed neighbourhood.

    twin: the group's smallest id; low: the neighbourhood's.  Only one list of a group is ever taken apart, so that a
    cluster whose members all link gives rows in proportion to its members.
    """
    closed = graph.select("id", F.array_sort(F.array_append("other", F.col("id"))).alias("c"))
    keyed = closed.select("id", F.get("c", F.lit(0)).alias("low"), F.size("c").alias("n"), F.xxhash64("c").alias("h"))
    first = keyed.groupBy("low", "n", "h").agg(F.min("id").alias("twin"))
    members = checkpoint(keyed.join(first, ["low", "n", "h"]).select("id", "twin", "low"))
    lists = graph.join(members.where("id = twin").select("id"), "id", "left_semi").withColumnRenamed("id", "twin")
    return members, lists


def refine(all_nodes: DataFrame, kind: str, graph: DataFrame, least: float) -> DataFrame:
    """Links found by comparing each node with the neighbours of its neighbours, in cells.

    A node's cells are the hubs of itself and of its neighbours; a node's hub is the smallest node within two
    steps.  A cell's members stand in blocks of BLOCK; each pair of blocks is compared in some task.
    """
    members, lists = twins(graph)
    steps = lists.select("twin", F.explode("other").alias("id"))
    far = steps.join(members.select("id", "low"), "id").groupBy("twin").agg(F.min("low").alias("far"))
    hubs = checkpoint(members.join(far, "twin").select("id", "twin", F.least("low", "far").alias("hub")))
    near = steps.join(hubs.select("id", "hub"), "id").select("twin", "hub").distinct()
    every = near.join(hubs.select("id", "twin"), "twin").select("id", "hub").unionByName(hubs.select("id", "hub"))
    cells = checkpoint(every.distinct())
    return in_cells(cells, all_nodes, kind, least)


def exhaustive(all_nodes: DataFrame, kind: str, least: float) -> DataFrame:
    """Links found by comparing all nodes of each label, in blocks."""
    return in_cells(all_nodes.select("id", F.xxhash64("label").alias("hub")), all_nodes, kind, least)


def in_cells(cells: DataFrame, all_nodes: DataFrame, kind: str, least: float) -> DataFrame:
    """LINKS among the members (id) of each cell (hub)."""
    size = cells.groupBy("hub").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # A member's block is drawn by its hash; each block meets every block from itself on.
    drawn = cells.join(size, "hub").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = drawn.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "hub", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block"
    )
    full = sent.join(all_nodes.select("id", "label", "vec"), "id")
    dealt = full.repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def group(t):
            for part in _by_width(t):
                unit, ids, block = _unit(part.column("vec").chunk(0), kind), part.column("id").to_numpy(), part.column("block").to_numpy()
                label = np.unique(part.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
                a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
                left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
                x, y = np.nonzero(_close(unit[left], unit[right], least))
                x, y = left[x], right[y]
                apart = (ids[x] < ids[y] if a == b else ids[x] != ids[y]) & (label[x] == label[y])
                yield from _lists(ids, [(x[apart], y[apart])] if apart.any() else [])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([t.column(c).to_numpy() for c in ("hub", "a", "b")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            begin = 0
            for end in ends.tolist():
                yield from group(t.slice(begin, end - begin))
                begin = end
            held = t.slice(begin)
        if held is not None and held.num_rows:
            yield from group(held)

    return dealt.select("id", "label", "hub", "a", "b", "block", "vec").mapInArrow(compare, LINKS)


def audit(all_nodes: DataFrame, kind: str, graph: DataFrame, least: float) -> tuple[int, int]:
    """(links of the audited nodes, those of them in ``graph``): AUDIT nodes against every node, in a scan."""
    import numpy as np

    chosen = all_nodes.orderBy(F.xxhash64("id")).limit(AUDIT)
    linked = all_nodes.join(graph.select("id"), "id", "left_semi").orderBy(F.xxhash64("id")).limit(AUDIT)
    asked = {r["id"]: (r["label"], bytes(r["vec"])) for r in chosen.unionByName(linked).collect()}
    shared = all_nodes.sparkSession.sparkContext.broadcast(asked)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _by_width(pa.Table.from_batches([batch])):
                column = part.column("vec").chunk(0)
                unit, ids, label = _unit(column, kind), part.column("id").to_numpy(), part.column("label").to_pylist()
                same: dict = {}
                for i, x in enumerate(label):
                    same.setdefault(x, []).append(i)
                hits = []
                for key, (own, vec) in shared.value.items():
                    if len(vec) == unit.shape[1] * np.dtype(kind).itemsize and own in same:
                        at = np.array(same[own])
                        for i in at[_close(unit[at], _unit(pa.array([vec]), kind), least)[:, 0]]:
                            if ids[i] != key:
                                hits.append((key, int(ids[i])))
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits]), pa.array([h[1] for h in hits])], names=["id", "other"])

    true = all_nodes.select("id", "label", "vec").mapInArrow(scan, "id long, other long")
    found = true.join(graph.withColumnRenamed("other", "known"), "id", "left").select(F.coalesce(F.array_contains("known", F.col("other")), F.lit(False)).alias("hit"))
    total = found.agg(F.count("*"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))).first()
    return total[0], total[1]


def link_graph(all_nodes: DataFrame, kind: str, least: float) -> tuple[DataFrame, int | None, int | None]:
    """(id, other): all links of each node that has one; and the links of the last audit, those of them that were found.

    Both are None if no audit was clean and all nodes of each label were compared, which is the last resort: each vector
    then meets every block of its label.
    """
    graph, most = None, most_bits(least)
    for batch in range(BATCHES):
        known = checkpoint(sketches(all_nodes, kind, batch))
        found = threshold_edges(descend(known, most), all_nodes, kind, least, most)
        graph = checkpoint(merge(found) if graph is None else merge(graph, found))
        total = graph.agg(F.sum(F.size("other"))).first()[0] or 0
        while total:
            graph = checkpoint(merge(graph, refine(all_nodes, kind, graph, least)))
            before, total = total, graph.agg(F.sum(F.size("other"))).first()[0]
            if total == before:
                break
        true, told = audit(all_nodes, kind, graph, least)
        if told == true:
            return graph, true, told
    return checkpoint(merge(exhaustive(all_nodes, kind, least))), None, None


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; recall and audited_links: of so many links of the audited nodes
    the share that was found (null without any; audited_links is null, recall 1, if all nodes of each label were compared).

    Rows link if their labels are equal and not null and their cosine is ``least`` or more, in double precision.
    Null, empty and zero vectors, those with a null or non-finite entry, and rows with a null id or label link
    with nothing: n_links 0, component_id their own id, kept true (null for a null id).  Equal rows link like any
    others; of rows that share an id none is told apart.  An empty table gives an empty result.
    """
    rows, kind = packed(vectors, id_col, vector_col, label_col), number_kind(vectors, vector_col)
    all_nodes = checkpoint(nodes(rows))
    graph, audited, found = link_graph(all_nodes, kind, least)
    recall = F.lit(1.0) if audited is None else F.lit(found / audited if audited else None).cast("double")
    members, lists = twins(graph)
    steps = checkpoint(lists.select("twin", F.explode("other").alias("id")))
    # Links count copies: one for each linked node, and those beyond one of every node of the closed neighbourhood.
    many = all_nodes.where("copies > 1").select("id", "copies")
    around = steps.unionByName(lists.select("twin", F.col("twin").alias("id")))
    beyond = around.join(many, "id").groupBy("twin").agg(F.sum(F.col("copies") - 1).alias("beyond"))
    edges = steps.unionByName(members.where("id <> twin").select("twin", "id"))
    groups = components(edges, "twin", "id").withColumnRenamed("node", "id")
    linked = graph.select("id", F.size("other").alias("others")).join(members.select("id", "twin"), "id").join(beyond, "twin", "left")
    counted = (
        all_nodes.join(linked.select("id", (F.col("others") + F.coalesce("beyond", F.lit(0))).alias("links")), "id", "left")
        .join(groups, "id", "left")
        .select("label", "key", F.coalesce("links", F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    joined = rows.select(F.col("id").alias("vec_id"), "label", "key").join(counted, ["label", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("recall", recall).withColumn("audited_links", F.lit(audited).cast("long"))

"""Near-duplicates by word shingles: texts whose sets of shingles have a Jaccard similarity of ``least`` or more.

SimHash fingerprints alone can't find these: at a similarity of 0.8 two fingerprints differ in 10 of 64 bits on average
and in up to 24, which unrelated texts often do too.  So fingerprints, of WORDS times 64 bits, are compared within groups
that share more: texts with equal sets are one node, and a set's minima under BANDS * ROWS permutations put it in one bucket per band; two
sets of similarity 0.8 share none with a chance of 5 in 100000, more similar ones with less.  Links come only from
comparing the sets themselves.  In each of STARS rounds the nodes of a bucket are compared with one of them, so that a group of
copies isn't expanded to all its pairs.  Nodes of buckets that still aren't one component meet once more, by the rarest
shingles of each: sets of similarity 0.8 always share one of the rarest fifth, while texts that only share a passage
hardly ever do.  Those that meet are searched for in a Gray-order index of their fingerprints, which are longer here
(LONG words): they tell a similarity of 0.7 from 0.8, so that in a group of copies with many changes few pairs are told
that aren't links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, components
from factloom.llm.simhash import GrayIndex, fingerprints, gray_rank, links, shingle_hashes, voted

BANDS, ROWS = 25, 5
#: Shingles permuted at once.
PERMUTED = 1024
#: 64-bit words of a fingerprint.  Fingerprints that differ in more bits, in all or in the first word, aren't compared
#: further: over 5 deviations more than the mean of sets of similarity 0.8.
WORDS, MOST_BITS, FIRST_BITS = 4, 72, 26
#: Bits in which SimHash fingerprints that are linked may differ.
BITS = 2
#: The same of the longer fingerprints: 2048 bits, of which 309 differ on average at 0.8, with a deviation of 16.
LONG, LONG_BITS = 32, 400
#: Rounds in which the nodes of a bucket are compared with one of them.
STARS = 4
#: Nodes of a bucket, and their shingles in all, that one task searches at once; larger buckets are cut into blocks, which
#: meet in pairs.
BLOCK, BLOCK_SHINGLES = 768, 1 << 20
#: Pairs that a task remembers so as to tell them once.
REMEMBERED = 500_000
#: Pairs that a task searches for, and compares by fingerprints, at once.
SEARCHED, COMPARED = 1 << 20, 1 << 15
#: Counters of shingles by which the rarest are told: they order the search and never change its result.
COUNTERS = 1 << 20
#: Nodes whose sets are asked for by a broadcast list; beyond that, all sets travel to the join that picks them.
LISTED_NODES = 2_000_000
PAIR = "a binary, b binary"


def shingle_set(text: str | None, words: int = 5):
    """Sorted distinct 64-bit hashes of the text's shingles; no words: none; fewer than ``words``: one shingle of all."""
    import numpy as np

    return np.unique(shingle_hashes(text, words))


def minima(hashes):
    """The smallest value of a non-empty set under each permutation."""
    import numpy as np

    drawn = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    turn, factor = drawn[0], drawn[1] | np.uint64(1)
    parts = [((hashes[at : at + PERMUTED] ^ turn) * factor).min(axis=1) for at in range(0, len(hashes), PERMUTED)]
    return np.minimum.reduce(parts)


def spread(hashes, words: int = WORDS):
    """The hashes, then ``words`` - 1 times hashes made of them, for further words of a fingerprint."""
    import numpy as np

    yield hashes
    for n in range(1, words):
        mixed = (hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        yield mixed ^ (mixed >> np.uint64(29))


def described(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fingerprint, node, size, keys, code) of each row: its SimHash fingerprint, its set's digest and size, a key
    per band, the words of the set's own fingerprint."""

    def describe(hashes):
        import numpy as np
        from xxhash import xxh3_128_digest, xxh64_intdigest

        own = np.unique(hashes)
        least = minima(own) if len(own) else np.zeros(0, dtype=np.uint64)
        keys = np.array([xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(least.reshape(-1, ROWS))], dtype=np.uint64)
        return xxh3_128_digest(own.tobytes()), len(own), keys.view(np.int64), [voted(x) for x in spread(own)]

    shape = {"node": "binary", "size": "long", "keys": "array<long>", "words": "array<long>"}
    made = fingerprints(docs, words, id_col, text_col, shape, describe)
    return made.withColumnsRenamed({"code": "fingerprint", "words": "code"})


def sets(docs: DataFrame, words: int, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of each distinct set among ``wanted`` (node)."""
    import numpy as np

    asked = None
    if wanted.count() <= LISTED_NODES:
        listed = wanted.select(F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").alias("n")).toArrow().column("n").to_numpy()
        asked = docs.sparkSession.sparkContext.broadcast(np.unique(listed))

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            own = [shingle_set(t, words).tobytes() for t in batch.column(0).to_pylist()]
            nodes = [xxh3_128_digest(o) for o in own]
            if asked is not None and nodes:
                # By the digest's first half: what else it lets pass goes in the join.
                half = np.frombuffer(b"".join(nodes), dtype=">i8")[::2].astype(np.int64)
                at = np.minimum(np.searchsorted(asked.value, half), max(0, len(asked.value) - 1))
                there = (asked.value[at] == half).tolist() if len(asked.value) else [False] * len(nodes)
                own, nodes = ([v for v, t in zip(values, there, strict=True) if t] for values in (own, nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.binary()), pa.array(own, type=pa.binary())], names=["node", "hashes"])

    found = docs.select(F.col(text_col)).mapInArrow(run, "node binary, hashes binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def rarest(known: DataFrame, least: float) -> DataFrame:
    """(node, key): of each set of n shingles the n - ceil(least * n) + 1 rarest; sets of that similarity share one of these."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(own, dtype="<u8") % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    slots = known.select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    shared = known.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, keys = [], []
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.frombuffer(own, dtype="<u8")
                most = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
                order = np.lexsort((hashes, shared.value[(hashes % np.uint64(COUNTERS)).astype(np.int64)]))[:most]
                nodes += [node] * len(order)
                keys.append(hashes[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.binary()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys]))], names=["node", "key"])

    return known.select("node", "hashes").mapInArrow(run, "node binary, key long")


def long_codes(known: DataFrame) -> DataFrame:
    """(node, code): the longer fingerprint of each set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes = [[voted(x) for x in spread(np.frombuffer(own, dtype="<u8"), LONG)] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, type=pa.list_(pa.int64()))], names=["node", "code"])

    return known.select("node", "hashes").mapInArrow(run, "node binary, code array<long>")


def differing(a: str, b: str) -> Column:
    """In how many bits two fingerprints differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)), F.lit(0))


def near_one(members: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's node that ``turn`` draws and those in other components that may link with it."""
    drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node", "size", "code", "component")).alias("one"))
    met = members.join(drawn, "key").where(F.col("component") != F.col("one.component"))
    close = (F.least("size", "one.size") >= least * F.greatest("size", "one.size")) & (differing("code", "one.code") <= MOST_BITS)
    return met.where(close).select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b")).distinct()


def whole_groups(batches, keys: tuple[str, ...]):
    """Tables of whole groups of equal ``keys`` from sorted batches, each with the places where its groups begin."""
    import numpy as np
    import pyarrow as pa

    def begins(t):
        key = np.stack([t.column(c).to_numpy() for c in keys])
        return np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if t.num_rows and (last := int(begins(t)[-1])):
            yield (whole := t.slice(0, last)), begins(whole)
            t = t.slice(last)
        held = t
    if held is not None and held.num_rows:
        yield held, begins(held)


def numbers(values: list):
    """An integer for each value, equal where the values are."""
    import numpy as np

    number = {x: i for i, x in enumerate(dict.fromkeys(values))}
    return np.fromiter(map(number.__getitem__, values), dtype=np.int64, count=len(values))


def words_of(column):
    """The longer fingerprints of a column, a row each."""
    import numpy as np

    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONG)


def forest(asked, known, code, size, component, least: float, hashes=None):
    """A spanning forest (x, y) of what may link between places in ``asked`` and ``known``, or of what does link.

    Candidates are nodes of different components that differ in at most LONG_BITS bits, found in a Gray-order index of
    ``known`` by the first word of their codes.  With their sets (``hashes``) these are compared, and components that are
    one by now aren't compared again.  ``asked`` and ``known`` are the same places or have none in common.
    """
    import numpy as np

    once, label = asked is known, np.arange(len(size)) if hashes is None else component.copy()
    if hashes is not None:
        begin = np.cumsum(size) - size
        terms, place = np.unique(np.concatenate(hashes), return_inverse=True)
        mark = np.zeros(len(terms), dtype=bool)
    known = known[np.argsort(gray_rank(code[known, 0]), kind="stable")]
    index, step = GrayIndex(code[known, 0]), max(1, SEARCHED // max(1, len(known)))
    for at in range(0, len(asked), step):
        who, leaf = index.search(code[asked[at : at + step], 0], FIRST_BITS)
        x, y = asked[at + who], known[leaf]
        good = (component[x] != component[y]) & (label[x] != label[y]) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]))
        good &= (x < y) if once else True
        x, y = x[good], y[good]
        near = [np.bitwise_count(code[x[n : n + COMPARED]] ^ code[y[n : n + COMPARED]]).sum(axis=1, dtype=np.int64) <= LONG_BITS for n in range(0, len(x), COMPARED)]
        near = np.concatenate([np.zeros(0, dtype=bool), *near])
        x, y = x[near], y[near]
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        for start, end in zip(cuts, cuts[1:] if len(x) else [], strict=False):
            one, others = int(x[start]), y[start:end]
            others = others[label[others] != label[one]]
            if hashes is not None and len(others):
                mark[place[begin[one] : begin[one] + size[one]]] = True
                lengths = size[others]
                starts = np.cumsum(lengths) - lengths
                own = np.arange(lengths.sum()) + np.repeat(begin[others] - starts, lengths)
                both = np.add.reduceat(mark[place[own]].astype(np.int64), starts)
                mark[place[begin[one] : begin[one] + size[one]]] = False
                others = others[both >= least * (size[one] + lengths - both)]
            for other in others.tolist():
                if label[one] != label[other]:
                    yield one, other
                    label[label == label[other]] = label[one]


def spanned(members: DataFrame, least: float, exact: bool) -> DataFrame:
    """Pairs (a, b) that unite the nodes of each key that may link, or do so by their sets (``exact``: column hashes).

    ``members``: key, node, size, component, code.  The nodes are compared by the task where they meet, which tells a
    spanning forest: fewer rows than nodes, however many pairs there are.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    drawn = members.join(members.groupBy("key").agg(blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each block meets every block from itself on.
    met = drawn.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = met.withColumns({"left": F.least("block", "with"), "right": F.greatest("block", "with")})
    dealt = sent.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: set = set()
        for t, first in whole_groups(batches, ("key", "left", "right")):
            code, size, node = words_of(t.column("code")), t.column("size").to_numpy(), t.column("node").to_pylist()
            block, sides = t.column("block").to_numpy(), [t.column(c).to_numpy() for c in ("left", "right")]
            component = numbers(t.column("component").to_pylist())
            for at, end in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
                here = slice(at, end)
                left, right = (np.flatnonzero(block[here] == side[at]) for side in sides)
                right = left if sides[0][at] == sides[1][at] else right
                if end - at < 2 or not len(left) or not len(right):
                    continue
                hashes = [np.frombuffer(h, dtype="<u8") for h in t.column("hashes")[here].to_pylist()] if exact else None
                found = forest(left, right, code[here], size[here], component[here], least, hashes)
                ends = {(min(x, y), max(x, y)) for i, j in found for x, y in [(node[at + i], node[at + j])]} - seen
                if ends:
                    seen.update(ends)
                    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], type=pa.binary()) for k in (0, 1)], names=["a", "b"])
            if len(seen) > REMEMBERED:
                seen.clear()

    return dealt.select("key", "left", "right", "block", "node", "size", "component", "code", *["hashes"] * exact).mapInArrow(run, PAIR)


def linked_others(members: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that unite all nodes of different components that link and share a key (key, node, size, component).

    Those that may link by their longer fingerprints are clusters first, so that each set travels to one place, where it
    is compared with the others of its cluster, and not to every key's.
    """
    codes = checkpoint(long_codes(known))
    clusters = components(spanned(members.join(codes, "node"), least, False))
    # The smallest node of a cluster, which names it, belongs to it too.
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    placed = members.select("node", "size", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node")
    whole = placed.withColumn("key", F.xxhash64("cluster")).join(codes, "node").join(known.select("node", "hashes"), "node")
    return spanned(whole, least, True)


def confirmed(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose sets have a Jaccard similarity of ``least`` or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both))
            yield from pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(good, type=pa.bool_())).to_batches()

    full = pairs.join(known.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, PAIR)


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest id among all rows reachable over links) and kept (doc_id = component_id).

    Null and wordless texts have equal, empty sets and so are one node.  Repeated rows are repeated in the result;
    of rows with one id none is told apart.  An empty table gives an empty result.
    """
    rows = checkpoint(described(docs, words, id_col, text_col))
    nodes = rows.groupBy("node").agg(*[F.min(c).alias(n) for c, n in (("doc_id", "first_id"), ("fingerprint", "fingerprint"))], *[F.first(c).alias(c) for c in ("size", "keys", "code")])
    # Fingerprints that the Gray-order index links are one more bucket.
    near = components(links(nodes.select(F.col("fingerprint").alias("code")).distinct(), BITS))
    alike = nodes.join(near.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("node", "size", "code", F.coalesce("component", "fingerprint").alias("key"))
    placed = nodes.select("node", "size", "code", F.explode("keys").alias("key")).unionByName(alike)
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = checkpoint(placed.join(shared, "key"))
    known = checkpoint(sets(docs, words, text_col, members.select("node").distinct()))
    edges, groups = [], None

    def told(rows: DataFrame) -> DataFrame:
        """``rows`` of nodes with their component."""
        return rows.withColumn("component", F.col("node")) if groups is None else rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def several(rows: DataFrame) -> DataFrame:
        """Those whose key has nodes of several components."""
        return rows.join(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "key")

    for step in range(STARS + 1):
        now = several(told(members)) if groups is not None else told(members)
        if step < STARS:
            found = confirmed(checkpoint(near_one(now, least, step)), known, least)
        else:
            open_ = checkpoint(now.select("node", "size").distinct())
            own = checkpoint(known.join(open_.select("node"), "node", "left_semi"))
            found = linked_others(checkpoint(several(told(rarest(own, least).join(open_, "node")))), own, least)
        edges.append(checkpoint(found))
        groups = components(reduce(DataFrame.unionByName, edges))
    named = nodes.select("node", "first_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = named.join(lowest, "component").select("node", "component_id")
    return rows.select("doc_id", "node").join(told, "node").select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))

"""SimHash near-duplicates: word-shingle fingerprints, linked through a Gray-order hierarchical index.

Two fingerprints that differ in at most ``bits`` places agree in one of ``bits + 1`` segments.  Each fingerprint
goes once per segment to the task of that segment's value, turned so that the segment leads.  There the
fingerprints stand in the order of their Gray rank; every FAN neighbours share an upper node, which holds the
masked bits all of them agree in, and so on upward.  A search adds up a fingerprint's differences from the bits
that each node adds to its parent's and drops a whole node once they exceed ``bits``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, checkpoint, components

FAN = 8
#: Fingerprints searched at once, which bounds a search's memory.
BLOCK = 2048
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def shingle_hashes(text: str | None, words: int = 3):
    """The hashes of the text's shingles, repeats included; no words: none; fewer than ``words``: one shingle of all."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    made = [
        np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at : at + SLICE], ends[at : at + SLICE])], dtype="<u8")
        for at in range(0, len(ends), SLICE)
    ]
    return np.concatenate(made)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The text's fingerprint as a signed 64-bit integer; no words: zero."""
    return voted(shingle_hashes(text, words))


def ones(hashes):
    """How many of the hashes have each bit set."""
    import numpy as np

    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(votes, total: int) -> int:
    """The bits that over half of ``total`` votes set, as a signed 64-bit integer."""
    import numpy as np

    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def voted(hashes) -> int:
    """The fingerprint of an array of shingle hashes; none: zero."""
    import numpy as np

    parts = [ones(hashes[at : at + SLICE]) for at in range(0, len(hashes), SLICE)]
    return majority(np.sum(parts, axis=0), len(hashes)) if parts else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", further: dict[str, str] | None = None, describe: Callable | None = None) -> DataFrame:
    """(doc_id, code) for each row of ``docs``; a null text has no words.

    ``further``: names and types (long, binary, array<long>) of columns that ``describe`` gives for the hashes of a text's
    shingles, so that these are worked out once.
    """
    bound_batches(docs.sparkSession)
    kinds = {"code": "long"} | (further or {})

    def run(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                made.append((voted(hashes), *(describe(hashes) if describe else ())))
            columns = zip(*made, strict=True) if made else [()] * len(kinds)
            arrays = [pa.array(values, type=types[kind]) for values, kind in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *kinds])

    shape = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"doc_id long, {shape}")


def gray_rank(codes):
    """Place of each code in the binary-reflected Gray sequence (unsigned 64-bit)."""
    import numpy as np

    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Upper nodes over codes in Gray order; a level's node covers FAN nodes of the level below."""

    def __init__(self, codes):
        import numpy as np

        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        bits, masks = [codes], [np.full(len(codes), full)]
        while len(bits[-1]) > FAN:
            at = np.arange(0, len(bits[-1]), FAN)
            one, zero = bits[-1] & masks[-1], ~bits[-1] & masks[-1]
            ones, zeros = np.bitwise_and.reduceat(one, at), np.bitwise_and.reduceat(zero, at)
            bits.append(ones)
            masks.append(ones | zeros)
        # A node keeps only the bits that its parent doesn't hold yet.
        for level in range(len(bits) - 1):
            masks[level] = masks[level] & ~np.repeat(masks[level + 1], FAN)[: len(masks[level])]
        self.bits, self.masks = bits, masks

    def search(self, codes, most: int):
        """Pairs (place in ``codes``, leaf) that differ in at most ``most`` bits."""
        import numpy as np

        top = len(self.bits) - 1
        who = np.repeat(np.arange(len(codes)), len(self.bits[top]))
        node = np.tile(np.arange(len(self.bits[top])), len(codes))
        differ = np.zeros(len(who), dtype=np.int64)
        for level in range(top, -1, -1):
            if level < top:
                who, differ = np.repeat(who, FAN), np.repeat(differ, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(self.bits[level])
                who, node, differ = who[there], node[there], differ[there]
            differ = differ + np.bitwise_count((codes[who] ^ self.bits[level][node]) & self.masks[level][node])
            near = differ <= most
            who, node, differ = who[near], node[near], differ[near]
        return who, node


def _merge(label, a, b):
    """Unite the sets of a[i] and b[i]; label: the smallest member known for each place."""
    import numpy as np

    while len(a):
        la, lb = label[a], label[b]
        if not (apart := la != lb).any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def linked(codes, lead: int, bits: int):
    """Each code's group within equal leading bits: the place of the group's first code.  Codes are in Gray order."""
    import numpy as np

    label = np.arange(len(codes))
    heads = codes >> np.uint64(64 - lead)
    first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(codes) else label
    sizes = np.diff(np.r_[first, len(codes)])
    last = np.repeat(first + sizes, sizes)
    small = np.repeat(sizes <= FAN, sizes)
    for step in range(1, FAN):
        a = np.flatnonzero(small & (np.arange(len(codes)) + step < last))
        near = np.bitwise_count(codes[a] ^ codes[a + step]) <= bits
        _merge(label, a[near], a[near] + step)
    for at, size in zip(first[sizes > FAN], sizes[sizes > FAN], strict=True):
        group = codes[at : at + size]
        index = GrayIndex(group)
        for begin in range(0, size, BLOCK):
            who, leaf = index.search(group[begin : begin + BLOCK], bits)
            _merge(label, at + begin + who, at + leaf)
    return label


def links(codes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): edges that connect exactly the codes reachable over steps of at most ``bits`` differing bits.

    ``codes``: one column ``code`` of distinct fingerprints.  A task returns a spanning star for each group it
    finds, never all pairs of it.
    """
    cuts = [round(64 * i / (bits + 1)) for i in range(bits + 2)]
    lead = min(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    turns = F.array(*[F.lit(c) for c in cuts[:-1]])
    turned = codes.select(F.explode(turns).alias("turn"), "code").select(
        "turn",
        F.expr("shiftleft(code, turn) | if(turn = 0, 0, shiftrightunsigned(code, 64 - turn))").alias("turned"),
    )
    turned = turned.repartition("turn", F.shiftrightunsigned("turned", 64 - lead))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if not got:
            return
        turn, code = (np.concatenate(x) for x in zip(*got, strict=True))
        for t in np.unique(turn):
            own = code[turn == t]
            own = own[np.argsort(gray_rank(own), kind="stable")]
            label = linked(own, lead, bits)
            apart = np.flatnonzero(label != np.arange(len(own)))
            back = lambda x, t=np.uint64(t): ((x >> t) | (x << (np.uint64(64) - t)) if t else x).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(back(own[apart])), pa.array(back(own[label[apart]]))], names=["a", "b"])

    return turned.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Each row's fingerprint, and the smallest id among all rows reachable over links of fingerprints.

    With a ``similarity``, texts link instead if the Jaccard similarity of their sets of shingles is that or more; see
    ``shingles``, which has no column fingerprint.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id, kept (doc_id = component_id).  Null and
    wordless texts have fingerprint zero and are linked like any other.  Repeated rows are repeated in the
    result; of rows with one id none is told apart.  An empty table gives an empty result.
    """
    if similarity is not None:
        from factloom.llm import shingles

        return shingles.near_duplicates(docs, words, similarity, id_col, text_col)
    rows = checkpoint(fingerprints(docs, words, id_col, text_col))
    codes = checkpoint(rows.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    groups = components(links(codes.select("code"), bits))
    joined = codes.join(groups.withColumnRenamed("node", "code"), "code", "left").withColumn(
        "component", F.coalesce("component", "code")
    )
    lowest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(lowest, "component").select("code", "component_id")
    return rows.join(named, "code").select(
        "doc_id",
        F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"),
        "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )

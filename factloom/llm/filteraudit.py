"""Filter interaction audit: what each of five filters removes in every order that they may be applied in.

A document is told by its mask, the set of filters that it fails.  For every mask one big integer holds, in packed
fields, its outcome at all 600 steps of the 120 orders.  Documents are counted by part, mask and label first, which
Spark does before the shuffle, so a part's sums take at most 128 integers times their counts however large the part
is.  A field has more bits than the part's number of documents, so no sum reaches the next field.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, checkpoint

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
#: Outcomes of a mask at a step; each is a field of the step.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))

ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(text: bytes) -> int:
    """The filters A to D that a text fails, as bits; ``text`` in UTF-8."""
    words = text.split()
    points, capitals = len(text.translate(None, CONTINUED)), len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, own, digest): the mask of A to D and a 128-bit digest of each row's whole text."""
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(2).to_pylist()]
            own = pa.array([own_mask(t) for t in texts], type=pa.int32())
            digest = pa.array([blake2b(t, digest_size=16).digest() for t in texts], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, digest], names=["doc_id", "part", "own", "digest"])

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary"))
    return slim.mapInArrow(run, "doc_id long, part string, own int, digest binary")


def outcomes(mask: int) -> list[tuple[bool, ...]]:
    """(kept, removed, redundant, unique_fails) of a mask at each of STEPS."""
    out = []
    for order, step in STEPS:
        here = 1 << FILTERS.index(order[step - 1])
        before = sum(1 << FILTERS.index(f) for f in order[: step - 1])
        gone, fails = bool(mask & before), bool(mask & here)
        out.append((not gone and not fails, fails and not gone, fails and gone, mask == here))
    return out


def packed(mask: int, bits: int) -> int:
    """The big integer of a mask: every outcome at every step as a field of ``bits`` bits."""
    return sum(int(x) << (bits * i) for i, x in enumerate(x for step in outcomes(mask) for x in step))


def unpacked(number: int, bits: int) -> list[int]:
    """The fields of a sum of packed integers."""
    count = len(STEPS) * len(OUTCOMES)
    raw, wide = number.to_bytes(count * bits // 8, "little"), bits // 8
    return [int.from_bytes(raw[i * wide : (i + 1) * wide], "little") for i in range(count)]


def steps_of(counted) -> list[tuple]:
    """The 600 rows of a part but for its name, of (mask, good, toxic, count) rows."""
    total = sum(n for *_, n in counted)
    bits = -(-(total.bit_length() + 1) // 8) * 8
    every = {mask: packed(mask, bits) for mask in {row[0] for row in counted}}
    add = lambda rows: unpacked(sum(every[mask] * n for mask, _, _, n in rows), bits)
    all_, good, toxic = add(counted), add(r for r in counted if r[1]), add(r for r in counted if r[2])
    wide = len(OUTCOMES)
    shapley = dict.fromkeys(FILTERS, 0)
    for i, (order, step) in enumerate(STEPS):
        shapley[order[step - 1]] += all_[i * wide + 1]
    return [(order, step, *all_[i * wide : (i + 1) * wide], good[i * wide + 1], toxic[i * wide + 1], shapley[order[step - 1]]) for i, (order, step) in enumerate(STEPS)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step with the counts of ROWS.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic; other columns are left alone.  A null text is
    empty, a null lang the part ``''``.  Rows count as they come: repeated ids are repeated documents.  A text repeats
    another if a smaller id has the same one, so rows of the smallest id never fail E, nor do rows without an id.
    A document is good (toxic) if any row of ``labels`` says so.  A text is held whole, in one task's memory.  An empty
    table gives no rows.
    """
    # Texts are read once; a short row of each is written.
    spread = checkpoint(masks(docs))
    first = spread.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # The smallest id of a text meets the text's rows by id, so that a text of very many documents isn't one key.
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    told = spread.join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left").select(
        "part", F.col("own").bitwiseOR(F.when(repeats, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    counted = told.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))

    def unpack(rows):
        import pandas as pd

        made = steps_of(list(zip(rows["mask"].tolist(), rows["good"].tolist(), rows["toxic"].tolist(), rows["n"].tolist(), strict=True)))
        frame = pd.DataFrame(made, columns=["filter_order", "step", *OUTCOMES, "good_lost", "toxic_lost", "shapley"])
        frame.insert(0, "part", rows["part"].iloc[0])
        return frame

    return counted.groupBy("part").applyInPandas(unpack, ROWS)

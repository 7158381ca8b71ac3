"""Helpers that the training-data operators share: checkpoints, bounded Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.rounds import cut as checkpoint
from factloom.operators.rounds import shared_folder

__all__ = ["bound_batches", "checkpoint", "components", "let", "once", "shared_folder", "table"]

#: Arrow batches of long texts stay under this many bytes, whatever the number of rows.
ARROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by size as well as by rows, so that very long texts don't pile up.

    This changes a setting of the session, which stays: the plans made later need it when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each evaluated once per row whatever later steps do with them.

    Filters and projections are not merged through a generator, as they are through a projection.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _forest(batches):
    """A spanning forest of one task's edges: every node points at the smallest node it reaches."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield _as_batch(pa, parent, root, kind)
            parent.clear()
    if kind is not None:
        yield _as_batch(pa, parent, root, kind)


def _as_batch(pa, parent, root, kind):
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], type=kind.field(i).type) for i in (0, 1)], schema=kind
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``; nodes without an edge are absent.

    Alternates large-star and small-star steps.  Each needs one minimum per node and one join, so a hub is
    never gathered in a list; before that, every task replaces its own edges by a spanning forest.  Null ends
    and loops are dropped; repeated edges count once.  An empty input gives an empty result.
    """
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    shape = f"u {kind}, v {kind}"
    pairs = checkpoint(pairs.mapInArrow(_forest, shape))
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                    F.struct(F.col("u"), F.col("low").alias("v")),
                )
            ).alias("e")
        )
        pairs = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now

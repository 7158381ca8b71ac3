"""Iterations: each round's rows are written to the folder that the cluster shares, so that plans don't grow."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a single machine, where it may be unset, one in the warehouse."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: worked out once, unlike by ``checkpoint``, which does so again to write."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each worked out once per row, whatever later steps do with them.

    Projections and filters aren't merged through a generator, as they are through a projection.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in the whole table's ``order``.

    Rows are dealt by ranges of the order, sorted and numbered within each, and moved on by the sizes of the ranges
    before, so that no task holds more than a range.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_within": within}))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # One row per range.
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")

"""Daily drops as a stream of files: each new day is applied by a run of its own, upon the runs before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.naming import incremental_day
from factloom.plans.ingest import ingest

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, day, bytes) of the files of drops below ``root``, as they arrive; contents are never read here."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(f"{root}/incremental")
    return files.select("path", incremental_day(F.col("path")).alias("day"), F.col("length").alias("bytes")).where("day IS NOT NULL")


def apply_drops(spark: SparkSession, root: str, store: str, now: str, ingest_day: Callable = ingest, **options) -> StreamingQuery:
    """Runs for every day whose files have arrived since the stream's checkpoint below ``store``; ends when there are no more.

    Days of one batch are applied in their order.  A batch that is repeated after a failure runs its days again, which
    changes nothing, as runs compare with the last one.
    """

    def apply(batch: DataFrame, _: int) -> None:
        for row in batch.select("day").distinct().orderBy("day").collect():
            ingest_day(spark, root, store, now, row["day"], **options)

    return new_files(spark, root).writeStream.foreachBatch(apply).option("checkpointLocation", f"{store}/stream").trigger(availableNow=True).start()


def drop_sizes(files: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, files, bytes) of a stream of files (day, bytes, at), updated as files arrive up to ``late`` after ``at``'s latest."""
    return files.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "day").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).select("day", "files", "bytes")

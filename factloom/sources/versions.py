"""Tables that change by deltas: a base and what was put in place of parts of it since.

A version holds rows and the keys that they replace.  A row counts unless a later version names its key, so a version
may replace all rows of a key, drop them (a key without rows), or only add rows (rows without a key).  What a version
writes is in proportion to what changed; once all deltas together hold more than COMPACT of the base's rows, the next
version is written as a new base.  The log names a version after its files are complete, so readers never meet half
of one.  Each version has the token of the run that wrote it; those of runs that never ended count for nothing, so a
run that is repeated meets the tables as the last complete run left them.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.files import read_table, write_lines

#: Deltas of more than this share of the base's rows are merged into a new base.
COMPACT = 0.25
LOG = "version long, token string, folder string, base boolean, rows long, keys long"


def written(rows: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write ``rows`` as Parquet and say how many they were, counted while they passed."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]


@dataclass
class Delta:
    """What a version wrote: its rows, the keys that it replaced, their numbers and whether a new base was made."""

    rows: DataFrame
    keys: DataFrame | None
    written: int
    replaced: int
    compacted: bool = False


@dataclass
class Versions:
    """The table below ``folder``, with rows of ``schema`` that belong to ``key`` (names of columns).

    ``token``: the run that writes; ``complete``: those that ended before it.
    """

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: list[str]
    token: str = ""
    complete: Collection[str] = field(default_factory=tuple)

    def log(self) -> list:
        """The last base and the deltas upon it, in order."""
        told = read_table(self.spark, f"{self.folder}/log", LOG).where(F.col("token").isin(self.token, *self.complete))
        every = told.orderBy("version").collect()
        bases = [i for i, r in enumerate(every) if r["base"]]
        return every[bases[-1] :] if bases else every

    def read(self) -> DataFrame:
        """The rows that count now; without a version, none."""
        log = self.log()
        if not log:
            return self.spark.createDataFrame([], self.schema)
        load = lambda r, part, schema: self.spark.read.schema(schema).parquet(f"{r['folder']}/{part}").withColumn("_version", F.lit(r["version"]))
        rows, keys = load(log[0], "rows", self.schema), None
        for r in log[1:]:
            rows = rows.unionByName(load(r, "rows", self.schema))
            if r["keys"]:
                named = load(r, "keys", self._key_schema())
                keys = named if keys is None else keys.unionByName(named)
        if keys is not None:
            last = keys.groupBy(*self.key).agg(F.max("_version").alias("_last"))
            same = [F.col(f"_rows.{k}").eqNullSafe(F.col(f"_keys.{k}")) for k in self.key] + [F.col("_keys._last") > F.col("_rows._version")]
            rows = rows.alias("_rows").join(last.alias("_keys"), same, "left_anti")
        return rows.select(*self.schema.names)

    def put(self, rows: DataFrame, keys: DataFrame | None = None) -> Delta:
        """The next version: ``rows`` in place of all earlier ones of ``keys``.

        The first version is the base, whatever its keys.  Rows are read before the log changes, so they may come from
        this table's own earlier versions.
        """
        log = self.log()
        number, folder = (log[-1]["version"] + 1 if log else 0), f"{self.folder}/{uuid4().hex}"
        count, replaced = written(rows.select(*self.schema.names), f"{folder}/rows"), 0
        if log and keys is not None:
            replaced = written(keys.select(*self.key).distinct(), f"{folder}/keys")
        self._tell(number, folder, not log, count, replaced)
        made = Delta(self.spark.read.schema(self.schema).parquet(f"{folder}/rows"), self.spark.read.schema(self._key_schema()).parquet(f"{folder}/keys") if replaced else None, count, replaced)
        if log and sum(r["rows"] for r in log[1:]) + count > COMPACT * log[0]["rows"]:
            self.compact()
            made.compacted = True
        return made

    def compact(self) -> None:
        """All rows that count as a new base."""
        log, folder = self.log(), f"{self.folder}/{uuid4().hex}"
        self._tell(log[-1]["version"] + 1, folder, True, written(self.read(), f"{folder}/rows"), 0)

    def _tell(self, number: int, folder: str, base: bool, rows: int, keys: int) -> None:
        write_lines(self.spark.createDataFrame([(number, self.token, folder, base, rows, keys)], LOG), f"{self.folder}/log", append=True)

    def _key_schema(self) -> T.StructType:
        return T.StructType([self.schema[k] for k in self.key])

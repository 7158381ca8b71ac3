"""Raw sources as DataFrames: file inventory, delimited and mail files, daily drops; and the matching sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from factloom.functions.naming import incremental_day
from factloom.functions.text import sha256, trim


def read_files(spark: SparkSession, root: str, through: str | None = None, base_only: bool = False) -> DataFrame:
    """(path, bytes, modified, content, raw_sha256, day) of every file below ``root``.

    path is relative to the folder that holds ``root``, and so begins with the last name of ``root``.  Files outside
    daily drops always count; those of a drop count if its day is not after ``through``, or if neither ``through`` nor
    ``base_only`` is given.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    # Paths come back as addresses; what follows the root's own name is kept.
    path = F.concat(F.lit(name), F.regexp_extract("path", f"/{re.escape(name)}(/.*)$", 1)) if "/" not in name else F.col("path")
    rows = files.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("raw_sha256")).withColumn("day", incremental_day(F.col("path")))
    if base_only:
        return rows.where("day IS NULL")
    return rows if through is None else rows.where(F.col("day").isNull() | (F.col("day") <= through))


def utf8(content: Column) -> Column:
    """Text of raw bytes without a byte order mark; what isn't UTF-8 is replaced."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def csv_rows(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, line_no, fields) for each data row of delimited files, all values text.

    The header decides between ; and , by which is more frequent.  Quoted fields may hold separators, doubled
    quotes and line feeds.  Names and values are trimmed, missing cells empty, surplus cells and blank rows dropped.
    """
    cell = r'("(?:[^"]|"")*"|[^%s\r\n]*)(%s|\r?\n|\r|$)'
    text = files.select(F.col(path_col).alias("path"), utf8(F.col(content_col)).alias("text"))
    header = F.substring_index(F.col("text"), "\n", 1)
    separator = F.when(F.length(header) - F.length(F.replace(header, F.lit(";"), F.lit(""))) > F.length(header) - F.length(F.replace(header, F.lit(","), F.lit(""))), ";").otherwise(",")
    rows = text.withColumn("separator", separator)
    one = lambda s, g: F.regexp_extract_all("text", F.lit(cell % (s, s)), F.lit(g))
    pick = lambda g: F.when(F.col("separator") == ";", one(";", g)).otherwise(one(",", g))
    cells = rows.select("path", F.arrays_zip(pick(1).alias("value"), pick(2).alias("end")).alias("cells"))
    # A cell's row is the number of line ends before it: a window over one file's cells.
    flat = cells.select("path", F.posexplode("cells").alias("at", "cell")).select("path", "at", "cell.value", F.col("cell.end").rlike(r"[\r\n]").cast("int").alias("ends"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    clean = F.when(F.col("value").startswith('"'), F.replace(F.regexp_replace("value", '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.col("value"))
    numbered = flat.select("path", "at", trim(clean).alias("value"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("row"))
    lines = numbered.groupBy("path", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
    filled = lines.where(F.exists("values", lambda x: x != ""))
    first = filled.groupBy("path").agg(F.min_by("values", "row").alias("names"), F.min("row").alias("top"))
    data = filled.join(first, "path").where("row > top")
    named = F.transform("names", lambda n, i: F.struct(n.alias("key"), F.coalesce(F.get("values", i), F.lit("")).alias("value")))
    return data.select("path", F.col("row").cast("long").alias("line_no"), F.map_from_entries(F.filter(named, lambda e: e["key"] != "")).alias("fields"))


def decode_quoted(body: Column, correct: bool = True) -> Column:
    """Quoted-printable text decoded: as UTF-8, or byte by byte as Latin-1 if not ``correct``."""
    joined = F.regexp_replace(body, r"=\r?\n", "")
    escaped = F.replace(F.replace(joined, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    text = F.try_url_decode(F.regexp_replace(escaped, "=([0-9A-Fa-f]{2})", "%$1"))
    return text if correct else F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def emails(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, headers, body, body_latin1) of mail files.

    Header names are lower-cased and folded lines joined; of repeated headers the last counts.
    """
    raw = files.select(F.col(path_col).alias("path"), utf8(F.col(content_col)).alias("raw"))
    blank = r"\r?\n\r?\n"
    parts = raw.select("path", F.get(F.split("raw", blank, 2), F.lit(0)).alias("head"), F.coalesce(F.get(F.split("raw", blank, 2), F.lit(1)), F.lit("")).alias("body"))
    lines = F.split(F.regexp_replace("head", r"\r?\n[ \t]+", " "), r"\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(trim(F.substring_index(x, ":", 1))).alias("key"), trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    headed = parts.select("path", F.map_from_entries(last).alias("headers"), "body")
    quoted = F.lower(F.coalesce(F.col("headers")["content-transfer-encoding"], F.lit(""))).contains("quoted-printable")
    return headed.select(
        "path", "headers",
        F.when(quoted, decode_quoted(F.col("body"))).otherwise(F.col("body")).alias("body"),
        F.when(quoted, decode_quoted(F.col("body"), correct=False)).otherwise(F.col("body")).alias("body_latin1"),
    )


def decoded_words(header: Column) -> Column:
    """A header with its UTF-8 encoded words (base64 or Q) in plain text; several in a row are joined."""
    joined = F.regexp_replace(header, r"\?=\s+=\?", "?==?")
    words = F.regexp_extract_all(joined, F.lit(r"((?:=\?[^?]+\?[BbQq]\?[^?]*\?=)|[^=]+|=)"), F.lit(1))

    def plain(x: Column) -> Column:
        body = F.regexp_extract(x, r"^=\?[^?]+\?[BbQq]\?([^?]*)\?=$", 1)
        return (
            F.when(x.rlike(r"^=\?[^?]+\?[Bb]\?"), F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8"))
            .when(x.rlike(r"^=\?[^?]+\?[Qq]\?"), decode_quoted(F.replace(body, F.lit("_"), F.lit(" "))))
            .otherwise(x)
        )

    return F.array_join(F.transform(words, plain), "")


def json_documents(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, document) of JSON files as variants; text that isn't JSON gives null."""
    return files.select(F.col(path_col).alias("path"), F.try_parse_json(utf8(F.col(content_col))).alias("document"))


def json_records(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, field, place, record) of each object in JSON files that hold a list of objects, or an object of such lists.

    field: the list's name, null for a plain list; an object that stands alone under a name is a record as well.
    Files that aren't JSON give none.  Record values are text, lists of text joined by a semicolon.
    """
    text = files.select(F.col(path_col).alias("path"), utf8(F.col(content_col)).alias("text")).where(F.try_parse_json("text").isNotNull())
    whole = text.select("path", F.when(F.trim("text").startswith("["), F.create_map(F.lit(""), F.col("text"))).otherwise(F.from_json("text", "map<string,string>")).alias("lists"))
    lists = whole.select("path", F.explode("lists").alias("field", "value"))
    value = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).when(F.trim("value").startswith("{"), F.array("value"))
    each = lists.select("path", F.nullif("field", F.lit("")).alias("field"), F.posexplode(value).alias("place", "text"))
    plain = lambda _, v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), ";")).otherwise(v)
    return each.where(F.trim("text").startswith("{")).select("path", "field", "place", F.transform_values(F.from_json("text", "map<string,string>"), plain).alias("record"))


def drops(files: DataFrame) -> DataFrame:
    """(day, files, bytes) of each daily drop."""
    return files.where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def applied_drops(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Drops with ``applied``: not after the latest day of the manifest's items that are not deleted."""
    latest = manifest.where("status <> 'deleted'").agg(F.max("day").alias("latest"))
    return listing.join(F.broadcast(latest)).withColumn("applied", F.coalesce(F.col("day") <= F.col("latest"), F.lit(False))).drop("latest")


def latest_day(files: DataFrame) -> DataFrame:
    return files.agg(F.max("day").alias("day"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, missing: bool = True) -> DataFrame:
    """A JSON-lines table; one that isn't there yet is empty if ``missing`` allows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if missing and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; ``append`` adds to what is there, as for corrections and logs."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Indented JSON, for tables that people read."""
    df.write.mode("overwrite").option("pretty", True).json(path)


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(F.col(text_col)).write.mode("overwrite").text(path)

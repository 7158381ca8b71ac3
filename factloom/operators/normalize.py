"""Sources as text and records: mails, invoices and letters as Markdown, ledgers and indexes as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import naming
from factloom.functions.text import file_stem, missing_if_blank, sha256, trim
from factloom.sources.files import csv_rows, emails, json_records, utf8

# The version that reuse is bound to, folders and endings of artifacts, texts of headings.
NORMALIZER_VERSION = 4
FOLDERS = {"email": "emails", "invoice_pdf": "invoices", "letter_pdf": "letters", "bank_csv": "bank", "bank_xml": "bank", "index_csv": "indexes", "master_data": "master-data", "incremental_manifest": "incremental"}
ENDINGS = {"email": ".md", "invoice_pdf": ".md", "letter_pdf": ".md", "bank_csv": ".jsonl", "index_csv": ".jsonl", "bank_xml": ".xml", "master_data": ".json", "incremental_manifest": ".json"}
ROOT = "workdir/normalized"
# End of fixed values.

TABULAR = ("bank_csv", "index_csv")
PENDING = ("discovered", "changed")
#: What a source's normal form tells besides its text; fields that a kind hasn't are null.
META = (
    "struct<headers:map<string,string>,body_length:int,row_count:bigint,format:string,filename:string,date:string,contractor_id:string,invoice_id:string,letter_type:string,letter_id:string,"
    "duplicate:boolean,fake:boolean,page_count:int,invoice_number:string,customer_number:string,invoice_date:string,net_amount:string,vat_amount:string,gross_amount:string,iban:string,title:string,"
    "subject:string,meeting_date:string,amount:string,decisions:array<string>>"
)


def _chosen(kind: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), kind)


def artifact_path(kind: Column, source_id: Column) -> Column:
    return F.concat(F.lit(f"{ROOT}/"), _chosen(kind, FOLDERS), F.lit("/"), file_stem(source_id), _chosen(kind, ENDINGS))


def sidecar_path(artifact: Column) -> Column:
    return F.regexp_replace(artifact, r"\.[^.]+$", ".meta.json")


def lines(*parts: Column | str) -> Column:
    """Lines of text; a part that is null is left out."""
    return F.array_join(F.filter(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), lambda x: x.isNotNull()), "\n")


def item(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("")))


def email_text(source_id: Column, path: Column, source_date: Column, headers: Column, body: Column) -> Column:
    return lines(
        F.concat(F.lit("# Email "), source_id), "", item("Source", path), item("Date", F.coalesce(headers["date"], source_date)), item("From", headers["from"]), item("To", headers["to"]),
        item("Subject", headers["subject"]), item("Message-ID", headers["message-id"]), "", "## Body", "", F.coalesce(body, F.lit("")),
    )


def invoice_text(source_id: Column, path: Column, source_date: Column, name: Column, found: Column, pages: Column, text: Column) -> Column:
    return lines(
        F.concat(F.lit("# Invoice PDF "), F.coalesce(name["invoice_id"], source_id)), "", item("Source", path), item("Date", F.coalesce(name["date"], source_date)), item("Contractor ID", name["contractor_id"]),
        item("Invoice ID", name["invoice_id"]), item("Extracted invoice number", found["invoice_number"]), item("Extracted gross amount", found["gross_amount"]), item("Extracted net amount", found["net_amount"]),
        item("Extracted VAT amount", found["vat_amount"]), item("PDF pages", pages), item("Duplicate marker", name["duplicate"]), item("Fake marker", name["fake"]), "", "## Extracted Text", "", text,
    )


def letter_text(source_id: Column, path: Column, source_date: Column, name: Column, found: Column, pages: Column, text: Column) -> Column:
    decided = F.when(F.size(found["decisions"]) > 0, F.concat(F.lit("## Extracted Decisions\n\n"), F.array_join(F.transform(found["decisions"], lambda d: F.concat(F.lit("- "), d)), "\n"), F.lit("\n")))
    return lines(
        F.concat(F.lit("# Letter PDF "), F.coalesce(name["letter_id"], source_id)), "", item("Source", path), item("Date", F.coalesce(name["date"], source_date)), item("Letter type", name["letter_type"]),
        item("Letter ID", name["letter_id"]), item("Extracted subject", found["subject"]), item("Extracted amount", found["amount"]), item("Extracted meeting decisions", F.size(found["decisions"])), item("PDF pages", pages), "",
        decided, "## Extracted Text", "", text,
    )


def meta(**fields: Column) -> Column:
    """The META struct of ``fields``."""
    names = [x.split(":")[0] for x in META.removeprefix("struct<").removesuffix(">").replace("map<string,string>", "map").split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(META)


def records(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, kind, file_name, field, line_no, row) of each row of tabular sources and of master data.

    ``sources``: source_id, kind, path; ``files``: path, content.  line_no counts a file's records from 1 on.
    """
    wanted = sources.where(F.col("kind").isin(*TABULAR, "master_data")).select("source_id", "kind", "path")
    own = files.select("path", "content").join(wanted, "path")
    table = csv_rows(own.where(F.col("kind").isin(*TABULAR) | naming.extension(F.col("path")).isin(".csv"))).select("path", F.lit(None).cast("string").alias("field"), "line_no", F.col("fields").alias("row"))
    objects = json_records(own.where((F.col("kind") == "master_data") & (naming.extension(F.col("path")) == ".json"))).select("path", "field", (F.col("place") + 1).cast("long").alias("line_no"), F.col("record").alias("row"))
    return table.unionByName(objects).join(wanted, "path").select("source_id", "kind", naming.file_name(F.col("path")).alias("file_name"), "field", "line_no", "row")


def normalize(sources: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """(source_id, status, artifact, text, normalized_sha256, meta) of the sources that are yet to be normalized.

    ``sources``: registry rows; ``files``: path, content; ``texts``: path, text, page_count of PDF files, which are read
    elsewhere.  A source whose file or text is missing has the status ``error`` and no artifact.  Tabular sources keep
    their rows in ``records``; here they have their number and a hash that doesn't depend on the rows' order.
    """
    wanted = sources.where(F.col("status").isin(*PENDING)).select("source_id", "kind", "path", "source_date")
    path, source, date = F.col("path"), F.col("source_id"), F.col("source_date")
    own = files.select("path", "content").join(wanted, "path")
    mails = emails(own.where("kind = 'email'")).join(wanted, "path")
    mail = mails.select("source_id", email_text(source, path, date, F.col("headers"), F.col("body_latin1")).alias("text"), meta(headers=F.col("headers"), body_length=F.length("body_latin1")).alias("meta"))
    read = wanted.where("kind IN ('invoice_pdf', 'letter_pdf')").join(texts.select("path", F.col("text").alias("raw"), "page_count"), "path").where("raw IS NOT NULL")
    parsed = read.withColumns({"invoice": naming.invoice_name(path), "letter": naming.letter_name(path), "in_invoice": naming.invoice_fields(F.col("raw")), "in_letter": naming.letter_fields(F.col("raw"))})
    fields = lambda *columns: {f: F.col(f"{c}.{f}") for c, names in columns for f in names}
    invoice = parsed.where("kind = 'invoice_pdf'").select(
        "source_id", invoice_text(source, path, date, F.col("invoice"), F.col("in_invoice"), F.col("page_count"), F.col("raw")).alias("text"),
        meta(page_count=F.col("page_count"), **fields(("invoice", ("filename", "date", "contractor_id", "invoice_id", "duplicate", "fake")), ("in_invoice", ("invoice_number", "customer_number", "invoice_date", "net_amount", "vat_amount", "gross_amount", "iban", "title")))).alias("meta"),
    )
    letter = parsed.where("kind = 'letter_pdf'").select(
        "source_id", letter_text(source, path, date, F.col("letter"), F.col("in_letter"), F.col("page_count"), F.col("raw")).alias("text"),
        meta(page_count=F.col("page_count"), **fields(("letter", ("filename", "date", "letter_type", "letter_id")), ("in_letter", ("subject", "meeting_date", "amount", "decisions")))).alias("meta"),
    )
    counted = records(wanted, files).groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("line_no", F.to_json("row")).cast("decimal(38,0)")).alias("h"))
    table = wanted.where(F.col("kind").isin(*TABULAR, "master_data")).join(files.select("path"), "path", "left_semi").join(counted, "source_id", "left")
    tabular = table.select("source_id", F.lit(None).cast("string").alias("text"), meta(row_count=F.coalesce("n", F.lit(0)), format=F.when(naming.extension(path) == ".json", "json").otherwise("csv")).alias("meta"), sha256(F.concat_ws(":", F.col("n").cast("string"), F.col("h").cast("string"))).alias("digest"))
    plain = own.where("kind IN ('bank_xml', 'incremental_manifest')").select("source_id", utf8(F.col("content")).alias("text"), meta(format=F.when(F.col("kind") == "bank_xml", "xml").otherwise("json")).alias("meta"))
    done = mail.unionByName(invoice).unionByName(letter).unionByName(plain).withColumn("digest", sha256(F.col("text"))).unionByName(tabular)
    return wanted.join(done, "source_id", "left").select(
        "source_id", F.when(F.col("meta").isNull(), "error").otherwise("normalized").alias("status"), F.when(F.col("meta").isNotNull(), artifact_path(F.col("kind"), source)).alias("artifact"), "text", F.col("digest").alias("normalized_sha256"), "meta",
    )


def registered(registry: DataFrame, normalized: DataFrame) -> DataFrame:
    """The registry with the status and artifacts of what was normalized now."""
    now = normalized.select("source_id", F.col("status").alias("_status"), "artifact", F.col("normalized_sha256").alias("_digest"))
    joined = registry.join(now, "source_id", "left")
    fresh = F.col("artifact").isNotNull()
    return joined.select(
        *[c for c in registry.columns if c not in ("status", "normalized_paths", "normalized_sha256", "normalizer_version")], F.coalesce("_status", "status").alias("status"),
        F.when(fresh, F.array("artifact")).otherwise(F.col("normalized_paths")).alias("normalized_paths"), F.coalesce("_digest", "normalized_sha256").alias("normalized_sha256"),
        F.when(fresh, F.lit(NORMALIZER_VERSION)).otherwise(F.col("normalizer_version")).alias("normalizer_version"),
    )


def header(meta_col: str, name: str) -> Column:
    return missing_if_blank(trim(F.col(f"{meta_col}.headers")[name]))

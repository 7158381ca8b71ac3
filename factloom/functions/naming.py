"""What a source's path tells: kind, declared ids, date, id, and the parts of invoice and letter names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import money_text, parse_money
from factloom.functions.text import let, missing_if_blank, normalize_whitespace, posix_path, trim

# Identifier patterns in the order in which they name a source, kinds, patterns of names and of texts.
DECLARED = (r"EMAIL-\d+", r"LTR-\d+", r"INV-(?:DUP-|FAKE-)?\d+", r"DL-(?:FAKE-)?\d+", r"TX-\d+")
SOURCE_NAMING = ("EMAIL-", "LTR-", "INV-")
KINDS = ("system_file", "incremental_manifest", "master_data", "index_csv", "email", "invoice_pdf", "letter_pdf", "bank_csv", "bank_xml", "unknown")
MASTER_ROOT = "data/stammdaten/"
INVOICE_NAME = r"^(\d{4})(\d{2})(\d{2})_(DL-(?:FAKE-)?\d+)_(INV-(?:DUP-|FAKE-)?\d+)\.pdf$"
LETTER_NAME = r"^(\d{4})(\d{2})(\d{2})_([^_]+(?:_[^_]+)*)_(LTR-\d+)\.pdf$"
INVOICE_NUMBER = (r"(?i)Rechnungsnr\.?:\s*([^\s\n]+)", r"(?i)Rechnung\s+(RE[-\d]+|INV[-\d/]+)")
CUSTOMER_NUMBER = (r"(?i)Kundennr\.?:\s*([^\n]+)",)
TEXT_DATE = (r"(?i)Datum:\s*(\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2})",)
NET_AMOUNT = (r"(?i)Summe netto:?\s*([\d.,-]+)\s*EUR", r"(?i)Netto:?\s*([\d.,-]+)\s*EUR")
VAT_AMOUNT = (r"(?i)(?:MwSt\.?\s*19%|zzgl\.\s*19%\s*MwSt):?\s*([\d.,-]+)\s*EUR", r"(?i)USt\.?:?\s*([\d.,-]+)\s*EUR")
GROSS_AMOUNT = (r"(?i)(?:Gesamtbetrag(?:\s+brutto)?|Rechnungsbetrag|Brutto):?\s*([\d.,-]+)\s*EUR",)
IBAN = (r"(?i)IBAN\s+([A-Z]{2}[A-Z0-9\s]{15,34})",)
INVOICE_TITLE = (r"(?i)\n([^\n]*(?:Rechnung|Jahresabrechnung)[^\n]*)\n",)
LETTER_SUBJECT = (r"(?i)\n([^\n]*(?:Eigentuemerversammlung|Hausgeld|Betriebskosten|Mahnung|Kuendigung|Mieterhoehung|Protokoll)[^\n]*)\n",)
LETTER_AMOUNT = (r"(?i)([\d.,-]+)\s*EUR",)
AGENDA_DECISION, MOST_DECISIONS = r"(?i)TOP\s+\d+:[^\n]+", 12
# End of fixed values.


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows, lower-cased; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def incremental_day(path: Column) -> Column:
    return missing_if_blank(F.regexp_extract(path, r"data/incremental/(day-\d+)", 1))


def classify(path: Column) -> Column:
    """The kind of a source by its path below the project's root; the first rule that fits decides."""
    path = posix_path(path)
    name, ending = file_name(path), extension(path)
    rules = {
        "system_file": (name == ".DS_Store") | name.startswith(".~"),
        "incremental_manifest": name == "incremental_manifest.json",
        "master_data": path.startswith(MASTER_ROOT) & ending.isin(".csv", ".json"),
        "index_csv": name.endswith("_index.csv"),
        "email": ending == ".eml",
        "invoice_pdf": path.contains("/rechnungen/") & (ending == ".pdf"),
        "letter_pdf": path.contains("/briefe/") & (ending == ".pdf"),
        "bank_csv": path.contains("/bank/") & (ending == ".csv"),
        "bank_xml": path.contains("/bank/") & (ending == ".xml"),
    }
    chain = None
    for kind, fits in rules.items():
        chain = F.when(fits, F.lit(kind)) if chain is None else chain.when(fits, F.lit(kind))
    return chain.otherwise("unknown")


def declared_ids(path: Column) -> Column:
    """Ids in the file name, each once, in the order of DECLARED."""
    name = file_name(path)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(name, F.lit(p), F.lit(0)) for p in DECLARED]))


def name_date(path: Column) -> Column:
    """yyyy-mm-dd of a file name that begins with yyyymmdd."""
    return F.when(file_name(path).rlike(r"^\d{8}"), F.regexp_replace(F.substring(file_name(path), 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def source_id(path: Column, declared: Column, raw_hash: Column) -> Column:
    """The first mail, letter or invoice id; else one made of folder, scope and name; else one of the hash."""
    path = posix_path(path)
    name, day = file_name(path), incremental_day(path)
    own = F.get(F.filter(declared, lambda x: F.exists(F.array(*map(F.lit, SOURCE_NAMING)), lambda p: x.startswith(p))), F.lit(0))
    stem = F.regexp_replace(F.upper(F.regexp_replace(name, r"\.[^.]+$", "")), "[^A-Z0-9]+", "-")
    scope = F.coalesce(F.concat(F.upper(day), F.lit("-")), F.lit("BASE-"))
    made = (
        F.when(path.startswith(MASTER_ROOT), F.concat(F.lit("MASTER-"), stem))
        .when((name == "incremental_manifest.json") & day.isNotNull(), F.concat(F.lit("INCR-"), F.upper(day), F.lit("-MANIFEST")))
        .when(name.endswith("_index.csv"), F.concat(F.lit("INDEX-"), scope, stem))
        .when(path.contains("/bank/"), F.concat(F.lit("BANK-"), scope, stem))
        .otherwise(F.concat(F.lit("SRC-"), F.substring(raw_hash, 1, 12)))
    )
    return F.coalesce(own, made)


def _part(name: Column, pattern: str, group: int) -> Column:
    return missing_if_blank(F.regexp_extract(name, pattern, group))


def _day(name: Column, pattern: str) -> Column:
    return F.when(name.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]))


def invoice_name(path: Column) -> Column:
    """struct(filename, date, contractor_id, invoice_id, duplicate, fake); the ids only if the whole name fits."""
    name = file_name(path)
    return F.struct(
        name.alias("filename"), _day(name, INVOICE_NAME).alias("date"), _part(name, INVOICE_NAME, 4).alias("contractor_id"), _part(name, INVOICE_NAME, 5).alias("invoice_id"),
        name.contains("INV-DUP-").alias("duplicate"), name.contains("FAKE").alias("fake"),
    )


def letter_name(path: Column) -> Column:
    """struct(filename, date, letter_type, letter_id) of a letter's file name, nulls unless the whole name fits."""
    name = file_name(path)
    return F.struct(name.alias("filename"), _day(name, LETTER_NAME).alias("date"), _part(name, LETTER_NAME, 4).alias("letter_type"), _part(name, LETTER_NAME, 5).alias("letter_id"))


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern's group that is not blank, trimmed."""
    return F.coalesce(*[let(trim(F.regexp_extract(text, p, 1)), lambda x: F.when(x != "", x)) for p in patterns])


def amount(text: Column, patterns: tuple[str, ...]) -> Column:
    return money_text(let(first_match(text, patterns), parse_money))


def invoice_fields(text: Column) -> Column:
    """What an invoice's text tells; missing fields are null."""
    return let(normalize_whitespace(text), _invoice_fields)


def _invoice_fields(compact: Column) -> Column:
    return F.struct(
        first_match(compact, INVOICE_NUMBER).alias("invoice_number"), first_match(compact, CUSTOMER_NUMBER).alias("customer_number"), first_match(compact, TEXT_DATE).alias("invoice_date"),
        amount(compact, NET_AMOUNT).alias("net_amount"), amount(compact, VAT_AMOUNT).alias("vat_amount"), amount(compact, GROSS_AMOUNT).alias("gross_amount"),
        first_match(compact, IBAN).alias("iban"), first_match(compact, INVOICE_TITLE).alias("title"),
    )


def letter_fields(text: Column) -> Column:
    """What a letter's text tells: subject, meeting date, amount, and its first MOST_DECISIONS decisions."""
    compact = normalize_whitespace(text)
    decisions = F.slice(F.transform(F.regexp_extract_all(compact, F.lit(AGENDA_DECISION), F.lit(0)), lambda x: trim(x)), 1, MOST_DECISIONS)
    return F.struct(
        first_match(compact, LETTER_SUBJECT).alias("subject"), first_match(compact, TEXT_DATE).alias("meeting_date"), amount(compact, LETTER_AMOUNT).alias("amount"),
        decisions.alias("decisions"), (F.size(decisions) > 0).alias("has_meeting_decisions"),
    )

"""Column functions over text: folding, trimming, identifiers, lists."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier families and their pattern, mail prefixes, folded letters.
ID_PATTERN = r"\b(?:LIE|HAUS|EH|EIG|MIE|DL|TX|INV|EMAIL|LTR)-[A-Z0-9-]*\d+\b"
OBSERVED_ID_PATTERN = r"\b(?:LIE|HAUS|EH|EIG|MIE|DL|TX|INV|EMAIL|THR|LTR)-[A-Z0-9-]*\d+\b"
VIEW_ID_PATTERN = r"\b(?:LIE|HAUS|EH|EIG|MIE|DL|TX|INV|EMAIL|LTR|FACT|WI|CORR)-[A-Z0-9-]*\d+\b"
SUBJECT_PREFIX = r"^\s*(re|aw|fw|fwd):\s*"
FOLD_PAIRS = (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))
DEFAULT_AUTHOR, AUTHOR_LENGTH = "frontend-user", 80
NO_ROWS = "_No facts available yet._"
# End of fixed values.

def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions, without combining marks, that fold_search tells from the character itself.

    Those of one character or none, and those of several.  Others hold nothing that fold_search keeps, so that they end
    as a space like the character.
    """
    one, several = {}, {}
    for code in range(0xA0, sys.maxunicode + 1):
        letter = chr(code)
        parts = unicodedata.normalize("NFKD", letter)
        if parts != letter:
            bare = "".join(x for x in parts if not "\u0300" <= x <= "\u036f")
            if len(bare) > 1 and re.search("[A-Za-z0-9@._+-]", bare):
                several[letter] = bare
            elif not bare or (len(bare) == 1 and bare.isascii()):
                one[letter] = bare
    return one, several


def _ranges(letters: Iterable[str]) -> str:
    """Letters as the inside of a pattern's class; what is not ASCII is asked first."""
    codes, parts = sorted(map(ord, letters)), []
    for code in codes:
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[\\x{80}-\\x{10FFFF}&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts) + "]]"


#: For translate(), where what has no counterpart is dropped; and letters that are several, written out where a text holds any.
ONE, SEVERAL = _decomposed()
_KEPT = [x for x in ONE if ONE[x]]
LETTERS, PLAIN_LETTERS = "".join(_KEPT + [x for x in ONE if not ONE[x]]), "".join(ONE[x] for x in _KEPT)
HOLDS_SEVERAL = _ranges(SEVERAL)
#: Runs of what fold_search doesn't keep.  Letters are listed one by one: Java looks these up in one table, but asks ranges one
#: after another.
UNSEARCHED = f"[^{string.ascii_lowercase}{string.digits}@._+-]+"

EDGES = r"^[\s ﻿]+|[\s ﻿]+$"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end (F.trim strips spaces only)."""
    return F.regexp_replace(c, EDGES, "")


def let(c: Column, told: Callable[[Column], Column]) -> Column:
    """``told(c)``, with ``c`` worked out once, however often ``told`` reads it."""
    return F.get(F.transform(F.array(c), told), F.lit(0))


def missing_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return trim(F.regexp_replace(c, r"[\s ]+", " "))


def normalize_whitespace(c: Column) -> Column:
    """Runs of blanks and tabs become one blank, three or more line feeds two; none at the ends.  Line feeds stay."""
    return trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def posix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def file_stem(c: Column) -> Column:
    """A name fit for files: no extension, only A-Z a-z 0-9 _ -, at most 120 characters."""
    bare = F.regexp_replace(c, r"\.[^.]+$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""), 1, 120)


def _fold(c: Column) -> Column:
    for letter, pair in FOLD_PAIRS:
        c = F.replace(c, F.lit(letter), F.lit(pair))
    return c


def fold_search(c: Column, fold_capitals: bool = False) -> Column:
    """Search form: German letters as pairs, accents gone, lower case, only a-z 0-9 @ . _ + - and single spaces.

    By default capital umlauts lose their dots only, as they are met before lower-casing; ``fold_capitals`` writes
    them as pairs too.
    """
    first = _fold(F.lower(c) if fold_capitals else c)
    written = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    wide = F.array_join(F.transform(F.split(first, ""), lambda x: F.coalesce(F.element_at(written, x), x)), "")
    spread = F.when(first.rlike(HOLDS_SEVERAL), wide).otherwise(first)
    # Marks that stand alone are dropped; others went with their letters.  Texts of ASCII alone have nothing to be written otherwise.
    bare = F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(spread, LETTERS, PLAIN_LETTERS), "[\u0300-\u036f]", "")).otherwise(c)
    return F.trim(F.regexp_replace(F.lower(bare), UNSEARCHED, " "))


def fold_triage(c: Column) -> Column:
    """Lower case with the German small letters as pairs."""
    return F.lower(_fold(c))


def subject_key(c: Column) -> Column:
    """A mail subject without one leading answer or forward prefix, lower-cased; blank: null."""
    return missing_if_blank(squeeze(F.regexp_replace(F.lower(c), SUBJECT_PREFIX, "")))


def message_id(c: Column) -> Column:
    return missing_if_blank(F.lower(trim(F.regexp_replace(c, "[<>]", ""))))


def mentions(c: Column, pattern: str = ID_PATTERN) -> Column:
    """Identifiers named in a text, each once, in order.

    Only where a first letter of the pattern's names stands is the pattern tried, which halves the time.
    """
    letters = "".join(sorted({name[0] for name in re.findall("[A-Z]+", pattern.partition(")")[0])}))
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?=[{letters}]){pattern}"), F.lit(0)))


def view_ids(c: Column, most: int = 18) -> Column:
    return F.slice(mentions(c, VIEW_ID_PATTERN), 1, most)


def split_list(c: Column) -> Column:
    """Parts between ; or , without blanks."""
    return F.filter(F.transform(F.split(c, "[;,]"), lambda x: trim(x)), lambda x: x != "")


def sorted_distinct(values: Column, unicode_order: bool = False) -> Column:
    """Distinct non-blank values in binary order, or in the order of the Unicode collation."""
    kept = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (trim(x) != "")))
    if not unicode_order:
        return F.array_sort(kept)

    def compare(a: Column, b: Column) -> Column:
        x, y = F.collate(a, "UNICODE"), F.collate(b, "UNICODE")
        return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(F.lit(0))

    return F.array_sort(kept, compare)


def first_sorted(values: Column, most: int = 12) -> Column:
    return F.slice(sorted_distinct(F.transform(values, lambda x: trim(x)), unicode_order=True), 1, most)


def without_missing(fields: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def month_of(date_text: Column, path: Column | None = None) -> Column:
    """yyyy-MM of an ISO date, else of a folder of the path, else ``undated``."""
    found = missing_if_blank(F.regexp_extract(date_text, r"^(\d{4}-\d{2})", 1))
    other = missing_if_blank(F.regexp_extract(path, r"/(\d{4}-\d{2})/", 1)) if path is not None else F.lit(None)
    return F.coalesce(found, other, F.lit("undated"))


def source_reference(ids: Column) -> Column:
    """The first four ids in brackets, with an ellipsis if there are more; none: nothing."""
    listed = F.concat(F.lit("["), F.array_join(F.slice(ids, 1, 4), ", "), F.when(F.size(ids) > 4, F.lit(", ...")).otherwise(""), F.lit("]"))
    return F.when(ids.isNull() | (F.size(ids) == 0), F.lit("")).otherwise(listed)


def first_quote(evidence: Column, most: int = 180) -> Column:
    """The first quote of an evidence list, on one line."""
    quoted = F.filter(evidence, lambda e: e["quote"].isNotNull())
    return F.substring(squeeze(F.get(quoted, F.lit(0))["quote"]), 1, most)


def shown(c: Column, kind: str) -> Column:
    """A field as text: lists joined by ; booleans as yes or no, null as nothing."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(c, "; "), F.lit(""))
    if kind == "boolean":
        return F.when(c.isNull(), F.lit("")).when(c, F.lit("yes")).otherwise("no")
    return F.coalesce(c.cast("string"), F.lit(""))


def cell(c: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))


def table_line(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def markdown_table(headers: list[str], rows: Column) -> Column:
    """A Markdown table of ``rows`` (array of arrays of text) with its header; without rows a note that there are none."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    head = F.lit(f"| {' | '.join(headers)} |\n| {' | '.join('---' for _ in headers)} |\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.lit(NO_ROWS)).otherwise(F.concat(head, F.array_join(lines, "\n")))


def attribute_text(c: Column) -> Column:
    """Text safe within an attribute of a protected block: letters, digits and _.@- only; nothing left: DEFAULT_AUTHOR."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_.@-]+", "-"), "^-+|-+$", "")
    return F.coalesce(missing_if_blank(F.substring(plain, 1, AUTHOR_LENGTH)), F.lit(DEFAULT_AUTHOR))


def protected_text(c: Column) -> Column:
    """Text that can't end the protected block it stands in: its end tags are broken up."""
    return trim(F.regexp_replace(c, "(?i)</user>", "</ user>"))


def human_bytes(c: Column) -> Column:
    return (
        F.when(c < 1024, F.format_string("%d B", c))
        .when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024))
        .otherwise(F.format_string("%.1f MB", c / (1024 * 1024)))
    )


def stable_id(prefix: str, value: Column) -> Column:
    """``prefix`` and the first 16 hexadecimal digits, in capitals, of the JSON text of ``value``.

    A struct's fields are written in their order and nulls left out, so equal structs give equal ids.
    """
    text = value if isinstance(value, Column) else F.lit(value)
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(text, 256), 1, 16)))


def json_id(prefix: str, **fields: Column) -> Column:
    return stable_id(prefix, F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def json_text(document: Column, name: str) -> Column:
    """A string field of a JSON text, blank as null."""
    return missing_if_blank(F.get_json_object(document, f"$.{name}"))


def json_list(document: Column, name: str) -> Column:
    """A list of strings of a JSON text, empty if there is none."""
    return F.coalesce(F.from_json(F.get_json_object(document, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))


def markdown_sections(text: Column) -> Column:
    """(title, body) of each second-level heading of a Markdown text."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n## "), 2, 1_000_000)
    return F.transform(parts, lambda p: F.struct(trim(F.substring_index(p, "\n", 1)).alias("title"), trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))


def markdown_bullets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^[-*] +(.*)$"), F.lit(1))


def markdown_rows(text: Column) -> Column:
    """Cells of each table line but the rule line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\|.*\|\s*$") & ~x.rlike(r"^\|[\s:|-]+\|\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"(?<!\\)\|"), lambda y: trim(y)))

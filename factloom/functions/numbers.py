"""Column functions over money and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let, missing_if_blank, trim

MONEY = "decimal(18,2)"


def parse_money(c: Column) -> Column:
    """An amount as decimal: with a comma, dots are thousands and the comma the decimal sign.

    Everything but digits, commas, dots and minus signs is dropped first; what follows the leading number is ignored;
    no leading number: null.
    """
    plain = lambda bare: F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    # No leading number gives an empty text, which is no decimal either.
    number = F.regexp_extract(let(F.regexp_replace(c, r"[^0-9,.-]", ""), plain), r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    return number.try_cast("decimal(30,6)").try_cast(MONEY)


def parse_number(c: Column) -> Column:
    return F.coalesce(parse_money(c), F.lit(0).cast(MONEY))


def money_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c.cast("double")))


def signed_payment(amount: Column, kind: Column) -> Column:
    """Negative amounts stay; debits and transfers out become negative."""
    out = F.lower(F.coalesce(kind, F.lit(""))).rlike("debit|ueberweisung|überweisung")
    return F.when(amount < 0, amount).when(out, -F.abs(amount)).otherwise(amount)


def iso_from_german(c: Column) -> Column:
    """dd.mm.yyyy as yyyy-mm-dd; anything else as it is."""
    return F.regexp_replace(trim(c), r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")


def mail_time(c: Column) -> Column:
    """The UTC time of an RFC 2822 date with a numeric or GMT zone, else null."""
    at = F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    zone = F.regexp_extract(c, r"([+-]\d{4})", 1)
    minutes = F.when(zone == "", F.lit(0)).otherwise(
        F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))
    )
    local = F.try_to_timestamp(missing_if_blank(at), F.lit("d MMM yyyy HH:mm:ss"))
    return local - F.make_dt_interval(mins=minutes)


def utc_day(c: Column) -> Column:
    """yyyy-MM-dd, in UTC, of a mail date or an ISO date or time; else the first ISO date within the text, else null."""
    zoned = F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), trim(c).try_cast("timestamp"))
    found = missing_if_blank(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1))
    return F.coalesce(F.date_format(mail_time(c), "yyyy-MM-dd"), F.date_format(F.to_utc_timestamp(zoned, F.current_timezone()), "yyyy-MM-dd"), found)


def epoch_millis(c: Column) -> Column:
    """Milliseconds of an ISO date, 0 if it is none."""
    return F.coalesce(F.unix_millis(F.substring(c, 1, 10).try_cast("timestamp")), F.lit(0).cast("long"))


def within(day: Column, start: Column, end: Column) -> Column:
    """Whether a day lies in a range; open ends and an unknown day pass."""
    return day.isNull() | ((start.isNull() | (day >= start)) & (end.isNull() | (day <= end)))


def within_dates(day: Column, start: Column, end: Column) -> Column:
    """``within`` for dates as text: one that can't be read counts as unknown."""
    return within(*[F.substring(c, 1, 10).try_cast("date") for c in (day, start, end)])

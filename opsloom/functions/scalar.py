"""Small scalar columns: safe casts, identifiers, dates, check digits, severities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"


def safe_int(value: Column) -> Column:
    """Whole number of a text or number, 0 when missing or malformed."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def exception_name(message: Column) -> Column:
    """Leading exception class of 'TimeoutError: upstream ...'; null for free text."""
    found = F.regexp_extract(message, r"^([A-Za-z_][\w.]*)\s*:", 1)
    return F.nullif(found, F.lit(""))


def joined_digest(parts: Sequence[Column]) -> Column:
    """sha256 over parts joined by the unit separator."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256)


def stable_id(*parts: Column) -> Column:
    return F.substring(joined_digest(parts), 1, 16)


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def args_hash(args: Column) -> Column:
    """Digest of a tool-argument map with a fixed key order."""
    entries = F.array_sort(F.map_entries(args))
    return F.substring(F.sha2(F.to_json(entries), 256), 1, 16)


def valid_npi(npi: Column) -> Column:
    """Ten digits starting with 1 or 2 whose check digit holds under the 80840 prefix."""
    shaped = F.coalesce(npi.rlike(r"^[12][0-9]{9}$"), F.lit(False))
    return F.when(shaped, F.call_function("luhn_check", F.concat(F.lit("80840"), npi))).otherwise(False)


def age_on(birth: Column, day: Column) -> Column:
    """Completed years on a day; a 29 February birthday counts from 1 March in common years."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - before.cast("int")


def active_on(day: Column, start: Column, end: Column) -> Column:
    return (start <= day) & (end.isNull() | (day <= end))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def severity_for(score: Column) -> Column:
    return F.when(score >= 12, "critical").when(score >= 7, "high").otherwise("medium")


def floor_div(value: Column, step: int) -> Column:
    """Whole number of steps below a (possibly negative) long, without floating-point loss."""
    unit = F.lit(step).cast("bigint")
    return ((value - F.pmod(value, unit)) / unit).cast("bigint")


def utc_day(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, 86_400 * 10**9).cast("int"))

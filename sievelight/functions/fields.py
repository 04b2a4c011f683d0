"""Expressions for expiry dates, machine-readable zones, ID numbers and region predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_currency, lines, strip

EXPIRY = r"(0[1-9]|1[0-2])[\-/](\d{2,4})"
ID_NUMBER, MRZ_LINE = "[A-Z0-9]{6,}", "^[A-Z0-9<]{30,44}$"


def expiry(text: Column, as_of: date) -> Column:
    """First expiry date as (text, raw, severity, validators), null without one; years before last year are suspicions."""
    raw = F.regexp_extract(text, EXPIRY, 0)
    month, year = F.regexp_extract(text, EXPIRY, 1), F.regexp_extract(text, EXPIRY, 2).try_cast("int")
    full = F.when(year < 100, year + 2000).otherwise(year)
    old = full < as_of.year - 1
    shown = F.concat(month, F.lit("/"), F.lpad((full % 100).cast("string"), 2, "0"))
    validators = F.when(old, F.array(F.lit("format_mm_yy"), F.lit("expired"))).otherwise(F.array(F.lit("format_mm_yy")))
    return F.when((raw != "") & (full >= 1), F.struct(shown.alias("text"), raw.alias("raw"), F.when(old, "suspicion").otherwise("hit").alias("severity"), validators.alias("validators")))


def mrz(text: Column) -> Column:
    """Up to three lines of a machine-readable zone, joined; null with fewer than two."""
    clean = F.transform(lines(text), lambda x: F.upper(F.replace(strip(x), F.lit(" "), F.lit(""))))
    found = F.filter(clean, lambda x: x.rlike(MRZ_LINE))
    return F.when(F.size(found) >= 2, F.array_join(F.slice(found, 1, 3), "\n"))


def id_number(text: Column) -> Column:
    found = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), ID_NUMBER, 0)
    return F.when(found != "", found)


def header_line(text: Column) -> Column:
    """Whether a line can name an account holder: a letter, under two amounts, and not mostly figures."""
    tokens = F.filter(F.split(strip(text), r"\s+"), lambda t: t != "")
    amounts = F.size(F.filter(tokens, is_currency))
    solid = F.regexp_replace(text, r"\s", "")
    figures = F.regexp_replace(solid, r"[^0-9.,£$()-]", "")
    return text.rlike(r"\p{L}") & (amounts < 2) & (F.length(figures) <= 0.6 * F.length(solid))

"""Scalar Column helpers (string, money, date) shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortkit import constants as K

MONEY = "decimal(18,2)"


# ---- strings ---------------------------------------------------------------------------------

# Python's whitespace set (str.isspace), derived by rule rather than listed.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove Python whitespace characters at both ends."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def strip_fences(c: Column) -> Column:
    """``.strip().strip('```json').strip('```').strip()`` (C4): the middle steps strip a set of
    characters from both ends, not a prefix. A text that begins and ends with none of them is left as it is, which
    spares most texts the four passes."""
    strips = F.lit(PY_WHITESPACE + "`json")
    inside = (F.instr(strips, F.substring(c, 1, 1)) == 0) & (F.instr(strips, F.substring(c, -1, 1)) == 0)
    return F.when(inside, c).otherwise(strip_ws(F.btrim(F.btrim(strip_ws(c), F.lit("`json")), F.lit("`"))))


def combine_text(html: Column, summary: Column) -> Column:
    """Classifier input text ``html + "\\n\\nSummary: " + summary``."""
    return F.concat(html, F.lit(K.SUMMARY_SEPARATOR), summary)


def hashed_customer_id(key: Column) -> Column:
    """``'CUST_S_' + sha1(str(key))[:8]``."""
    return F.concat(F.lit(K.STAT_CUSTOMER_PREFIX), F.substring(F.sha1(key.cast("string")), 1, 8))


# ---- money -----------------------------------------------------------------------------------

def money(c: Column) -> Column:
    return c.cast(MONEY)


def cents_to_money(cents: Column) -> Column:
    """Exact bigint cents to decimal(18,2)."""
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def tax_of(subtotal: Column) -> Column:
    """``round(subtotal * TAX_RATE, 2)`` on decimals, HALF_UP (A1, Q1)."""
    return F.round(subtotal * F.lit(Decimal(K.TAX_RATE)), 2).try_cast(MONEY)


# ---- dates -----------------------------------------------------------------------------------

def coerce_datetime(s: Column) -> Column:
    """Parse ISO-8601 text to a wall-clock TIMESTAMP_NTZ; anything else is NULL.

    The text must start with ``yyyy-mm-dd``; offsets such as ``+05:00`` or ``Z`` keep the
    written wall clock.
    """
    return F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}")), s.try_cast("timestamp_ntz"))


def iso_week(ts: Column) -> Column:
    """ISO-8601 week number (C14)."""
    return F.weekofyear(ts)


def weekday_name(ts: Column) -> Column:
    """English weekday name."""
    return F.date_format(ts, "EEEE")

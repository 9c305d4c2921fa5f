"""Money is whole paise in a bigint; text and double inputs are converted once, here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paise_from_double(rupees: Column) -> Column:
    return F.round(rupees * 100).cast("long")


def paise_from_text(text: Column) -> Column:
    """``1299`` or ``1299.5`` or ``1299.50`` rupees to paise with integer arithmetic; else NULL."""
    t = F.trim(text)
    frac = F.rpad(F.coalesce(F.get(F.split(t, r"\."), F.lit(1)), F.lit("")), 2, "0")
    value = F.get(F.split(t, r"\."), F.lit(0)).try_cast("long") * 100 + frac.try_cast("long")
    return F.when(t.rlike(r"^\d{1,15}(\.\d{1,2})?$"), value)


def format_inr(paise: Column) -> Column:
    """Rupee text with Indian grouping: the last three digits, then pairs."""
    mag = F.abs(paise)
    whole = F.floor(mag / 100).cast("long").cast("string")
    head = F.substring(whole, F.lit(1), F.length(whole) - 3)
    tail = F.substring(whole, F.length(whole) - 2, F.lit(3))
    whole = F.when(F.length(whole) <= 3, whole).otherwise(
        F.concat(F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), tail))
    frac = F.lpad((mag % 100).cast("string"), 2, "0")
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), whole, F.lit("."), frac)


def constrain_money(c: Column) -> Column:
    return c.isNotNull() & (c >= 0)

"""Prices: parsing, rounding, positions, sale windows.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import rules


def round2(x: Column) -> Column:
    """Two decimals, halves toward positive infinity."""
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def classify_position(ours: Column, theirs: Column) -> Column:
    """lower, equal or higher: where our price stands; null if either is."""
    d = ours - theirs
    return F.when(F.abs(d) < 0.005, "equal").when(d < 0, "lower").when(d >= 0, "higher")


def delta_abs(ours: Column, theirs: Column) -> Column:
    return round2(ours - theirs)


def delta_pct(ours: Column, theirs: Column) -> Column:
    """Per cent of their price; null if that is 0 or either is null."""
    return F.when(theirs != 0, round2((ours - theirs) / F.nullif(theirs, F.lit(0.0)) * 100))


def parse_price(raw: Column) -> Column:
    """The first number of a text.  The later of comma and point is the decimal one; others group thousands."""
    text = F.regexp_replace(raw, "\u00a0", " ")
    digits = F.regexp_replace(F.regexp_extract(text, rules.FIRST_NUMBER, 1), r"\s", "")
    place = lambda x: F.when(F.instr(digits, x) > 0, F.length(digits) - F.instr(F.reverse(digits), x)).otherwise(-1)
    pointless = F.replace(digits, F.lit("."), F.lit(""))
    whole = F.substring_index(pointless, ",", 1)
    decimal_comma = F.concat(whole, F.lit("."), F.substring(pointless, F.length(whole) + 2, F.length(pointless)))
    number = F.when(place(",") > place("."), decimal_comma).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    return round2(F.regexp_extract(number, r"^\d*\.?\d*", 0).try_cast("double"))


def feed_price(raw: Column) -> Column:
    """The amount of '1,250.50 GBP'; null if the text is anything else."""
    amount = F.regexp_replace(F.regexp_extract(F.trim(raw), r"(?i)^([\d.,]+)\s*([A-Z]{3})?$", 1), ",", "")
    return F.regexp_extract(amount, r"^\d*\.?\d*", 0).try_cast("double")


def feed_currency(raw: Column) -> Column:
    """The currency code of a feed price, in capitals; null without."""
    code = F.regexp_extract(F.trim(raw), r"(?i)^([\d.,]+)\s*([A-Z]{3})?$", 2)
    return F.upper(F.nullif(code, F.lit("")))


def sale_window_open(raw: Column, now: Column) -> Column:
    """Whether now lies in 'from/to', both included; a blank or unreadable end is open."""
    whole = F.regexp_replace(F.coalesce(raw, F.lit("")), r"T(\d\d:\d\d)(?=$|[Z/+-])", "T$1:00")
    whole = F.regexp_replace(whole, r"([+-]\d\d)(\d\d)(?=$|/)", "$1:$2")
    side = lambda i: F.try_to_timestamp(F.get(F.split(whole, "/"), F.lit(i)))
    return F.coalesce(now >= side(0), F.lit(True)) & F.coalesce(now <= side(1), F.lit(True))


def purchasable(price: Column, in_stock: Column) -> Column:
    """Priced, and not known to be out of stock."""
    return price.isNotNull() & ~in_stock.eqNullSafe(F.lit(False))

"""What users read: money, shares, times, labels, colours.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import rules

NONE = "\u2014"
#: Signs of the currencies that are shown with one.
SIGNS = {"GBP": "\u00a3", "EUR": "\u20ac", "USD": "US$"}


def _named(x: Column, names: dict[str, str]) -> Column:
    """The name of a value; the value itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in names.items() for y in pair]), x), x)


def tier_label(x: Column) -> Column:
    return _named(x, rules.TIER_LABELS)


def mode_label(x: Column) -> Column:
    return _named(x, rules.MODE_LABELS)


def error_label(x: Column) -> Column:
    return _named(x, rules.ERROR_LABELS)


def money_text(x: Column, currency: Column) -> Column:
    """A sum with its sign, thousands grouped, two decimals, a minus before the sign; a dash for none."""
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in SIGNS.items() for y in pair]), currency), F.concat(currency, F.lit("\u00a0")))
    return F.when(x.isNull(), NONE).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), sign, F.format_number(F.abs(x), 2)))


def percent_text(x: Column) -> Column:
    """A share of one decimal, with a plus above zero; a dash for none."""
    return F.when(x.isNull(), NONE).otherwise(F.concat(F.when(x > 0, "+").otherwise(""), F.format_string("%.1f%%", x)))


def day_text(x: Column) -> Column:
    """Day, month, hour and minute of a time; a dash for none."""
    return F.coalesce(F.date_format(x, "dd MMM, HH:mm"), F.lit(NONE))


def iso_text(x: Column) -> Column:
    """A time (UTC) as ISO 8601 with milliseconds; null for none."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _rounded(x: Column) -> Column:
    """To whole numbers, halves upward."""
    return F.floor(x + F.lit(0.5))


def relative_time(x: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days."""
    seconds = F.unix_micros(now.cast("timestamp")) / F.lit(1e6) - F.unix_micros(x.cast("timestamp")) / F.lit(1e6)
    minutes = _rounded(seconds / 60)
    hours = _rounded(minutes / 60)
    return (
        F.when(x.isNull(), "never")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.format_string("%dm ago", minutes))
        .when(hours < 24, F.format_string("%dh ago", hours))
        .otherwise(F.format_string("%dd ago", _rounded(hours / 24)))
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null if either is."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)


def confidence_tone(x: Column) -> Column:
    return F.when(x >= rules.TONE_HIGH, "high").when(x >= rules.TONE_MID, "mid").when(x.isNotNull(), "low")


def brand_hue(brand: Column) -> Column:
    """One of a few colours by a 32-bit hash of the brand's characters."""
    step = lambda h, c: (h * 31 + F.ascii(c)) % F.lit(2**32)
    hashed = F.aggregate(F.filter(F.split(brand, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.get(F.array(*[F.lit(h) for h in rules.BRAND_HUES]), (hashed % len(rules.BRAND_HUES)).cast("int"))


def product_detail(specs: Column, identifier: Column) -> Column:
    """Size, material, carats and identifier of a product, those that it has."""
    of = lambda name: F.nullif(F.try_element_at(specs, F.lit(name)), F.lit(""))
    return F.concat_ws(" \u00b7 ", of("case_size"), of("case_material"), of("carat_weight"), F.nullif(identifier, F.lit("")))


def host_of(url: Column) -> Column:
    """An address's host and port; the text itself if it is no address."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit("")), url)


def completeness(priced: Column, missing: Column) -> Column:
    """How many products a site prices, and how many it does not."""
    return F.when(missing > 0, F.format_string("%d (%d without)", priced, missing)).otherwise(F.format_string(f"%d {NONE} complete", priced))

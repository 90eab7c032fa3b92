"""Texts, identifiers and attribute values in one spelling.  Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import rules


def let(x: Column, f) -> Column:
    """f(x), x being computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _first(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return F.coalesce(*[F.when(c, v) for c, v in pairs], otherwise)


def _number(text: Column) -> Column:
    """A number as text without a trailing .0; null if it is none."""
    return F.regexp_replace(text.try_cast("double").cast("string"), r"\.0$", "")


def normalise_text(x: Column) -> Column:
    out = F.regexp_replace(F.lower(x), "[‘’“”]", "'")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^a-z0-9.\s-]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalise_identifier(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def case_size(x: Column) -> Column:
    """Millimetres: '40.5 mm' and '40.5' are 40.5; null otherwise."""
    return _number(F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in (rules.SIZE_MM, rules.SIZE_BARE)]))


def colour(x: Column) -> Column:
    pairs = lambda text: [(text.rlike(rules.MOTHER_OF_PEARL), F.lit("mother of pearl"))] + [(text.rlike(rf"\b{word}\b"), F.lit(name)) for word, name in rules.COLOURS.items()]
    return let(normalise_text(x), lambda text: _first(pairs(text), text))


def material(x: Column) -> Column:
    return _first([(x.rlike(f"(?i){pattern}"), F.lit(name)) for pattern, name in rules.MATERIALS], normalise_text(x))


def movement(x: Column) -> Column:
    return let(normalise_text(x), lambda text: _first([(text.rlike(pattern), F.lit(name)) for pattern, name in rules.MOVEMENTS], text))


def carat(x: Column) -> Column:
    """A fraction, else a number before ct or carat, else a bare number; null otherwise."""
    top, bottom = (F.regexp_extract(x, rules.FRACTION, i).try_cast("double") for i in (1, 2))
    fraction = F.when(bottom != 0, F.regexp_replace(F.try_divide(top, bottom).cast("string"), r"\.0$", ""))
    patterns = (rules.CARAT, rules.CARAT_BARE)
    return F.coalesce(fraction, _number(F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in patterns])))


def canonical_attribute(x: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[\s-]+", "_"), "[^a-z0-9_]", "")
    aliases = F.create_map(*[F.lit(y) for pair in rules.ALIASES.items() for y in pair])
    return F.coalesce(F.try_element_at(aliases, slug), slug)


def normalise_attribute(attribute: Column, value: Column) -> Column:
    """The value in the one spelling of its attribute; null if nothing is left."""
    raw = F.trim(value)
    materials = attribute.isin("case_material", "strap_material", "bracelet_material", "metal_type")
    out = (
        F.when(attribute == "case_size", case_size(raw))
        .when(attribute.isin("dial_colour", "diamond_colour"), colour(raw))
        .when(materials, material(raw))
        .when(attribute == "carat_weight", carat(raw))
        .when(attribute == "movement", movement(raw))
        .when(attribute == "reference_number", normalise_identifier(raw))
        .otherwise(normalise_text(raw))
    )
    return F.nullif(F.when(raw != "", out), F.lit(""))


def category_of(x: Column) -> Column:
    """The name of the rule set of a product category."""
    low = F.lower(x)
    pairs = [
        (reduce(lambda a, b: a | b, [low.contains(k) for k in keywords]), F.lit(name))
        for name, (keywords, *_) in rules.CATEGORIES.items()
        if keywords
    ]
    return _first(pairs, F.lit("default"))


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalise_text(x), " "), lambda t: t != ""))


def dice(x: Column, y: Column) -> Column:
    """Dice coefficient of two arrays of distinct words; 0 if either has none."""
    both = F.size(x) + F.size(y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct words; 0 if either has none."""
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda t: dice(t["a"], t["b"]))


def slug_words(url: Column) -> Column:
    """The words of an address's path; of the whole text if it is no address."""
    path = F.try_parse_url(url, F.lit("PATH"))
    known = F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), path)
    text = F.coalesce(F.try_url_decode(known), known, url)
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def search_terms(brand: Column, name: Column, reference: Column) -> Column:
    """Up to eight distinct words, the longest first, of equals the earlier."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", brand, name, F.trim(reference))), "[^a-z0-9]+", " ")
    stop = F.array(*[F.lit(w) for w in rules.STOP_WORDS])
    words = F.array_distinct(F.filter(F.split(text, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))
    ranked = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(ranked), lambda s: s["w"]), 1, 8)


def damaged_identifier(x: Column) -> Column:
    """Whether a spreadsheet has turned the number into scientific notation."""
    return x.rlike(rules.DAMAGED_IDENTIFIER)


def usable_identifier(gtin: Column, mpn: Column) -> Column:
    """The barcode if it is whole, else the part number if that is, else null."""
    whole = lambda x: F.when((F.trim(x) != "") & ~damaged_identifier(F.trim(x)), F.trim(x))
    return F.coalesce(whole(gtin), whole(mpn))


def availability(x: Column) -> Column:
    """False, true or null (not known)."""
    low = F.lower(x)
    return F.when(low.rlike(rules.GONE), False).when(low.rlike(rules.THERE), True)


def error_kind(status: Column) -> Column:
    """What an HTTP status means for a listing; null below 400."""
    return (
        F.when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403, 429, 451), "blocked")
        .when(status >= 400, "http_error")
    )


def retryable(kind: Column) -> Column:
    return kind.isin("timeout", "navigation_failed", "http_error")


def text_supports(haystack: Column, attribute: Column, value: Column) -> Column:
    """Whether a value of at least three characters stands in the haystack; sizes need their unit after them."""
    sized = F.regexp_like(haystack, F.concat(F.lit(r"\b"), value, F.lit(r"\s*mm\b")))
    found = F.when(attribute == "case_size", sized).otherwise(F.contains(haystack, value))
    return F.coalesce((F.length(value) >= 3) & found, F.lit(False))


def search_term(brand: Column, name: Column, specs: Column) -> Column:
    """What a shop is asked for: the brand with the reference number where one is known, else with the product's name."""
    reference = F.nullif(F.trim(spec_value(canonical_specs(specs), F.lit("reference_number"))), F.lit(""))
    return F.trim(F.concat_ws(" ", brand, F.coalesce(reference, name)))


def canonical_specs(specs: Column) -> Column:
    """A map's non-blank entries as an array of (k, v) under canonical names, in the order of their own names."""
    entries = F.array_sort(F.map_entries(specs))
    return F.transform(F.filter(entries, lambda e: F.trim(e["value"]) != ""), lambda e: F.struct(canonical_attribute(e["key"]).alias("k"), e["value"].alias("v")))


def spec_value(entries: Column, attribute: Column) -> Column:
    """The value of an attribute among canonical_specs(); of several entries the last."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == attribute), F.lit(-1))["v"]


def run_item_detail(stored: Column, confirmed: Column, found: Column, best_url: Column, reason: Column) -> Column:
    """What a discovery attempt led to, as a sentence."""
    return (
        F.when(stored > 0, F.format_string("stored %d candidates, of which %d were confirmed at once", stored, confirmed))
        .when(best_url.isNotNull(), F.format_string("%d addresses found; the nearest, %s, was turned down: %s", found, best_url, reason))
        .otherwise(F.format_string("%d addresses found, of which none could be opened", found))
    )


def initials(name: Column) -> Column:
    """A logo's letters: the first of the first two words, or of the only one; '?' without any."""
    plain = F.regexp_replace(F.regexp_replace(name, "['’`]", ""), r"[^\p{L}\p{N}\s-]", " ")
    words = F.filter(F.split(plain, r"[\s-]+"), lambda w: w != "")
    letters = F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1))
    return F.when(F.size(words) > 0, F.upper(F.array_join(letters, ""))).otherwise("?")


def hue(slug: Column) -> Column:
    """A colour's angle from 190 to 330, the same for a slug every time."""
    step = lambda h, c: (h * 31 + F.ascii(c)) % 100_000
    return F.aggregate(F.filter(F.split(slug, ""), lambda c: c != ""), F.lit(0), step) % 141 + 190


def detect_delimiter(line: Column) -> Column:
    """The most frequent of comma, tab, semicolon and bar in a header line; of equals the first, comma if there is none."""
    n = lambda x: F.length(line) - F.length(F.replace(line, F.lit(x), F.lit("")))
    marks = [",", "\t", ";", "|"]
    most = F.greatest(*[n(x) for x in marks])
    return F.coalesce(*[F.when(n(x) == most, F.lit(x)) for x in marks], F.lit(","))


def detect_format(content: Column) -> Column:
    """xlsx, legacy-xls, html or text, by a file's first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.lower(F.trim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return (
        F.when(head.startswith("504B"), "xlsx")
        .when(head == "D0CF11E0A1B11AE1", "legacy-xls")
        .when(start.rlike(r"^(<html|<\?xml|<table)"), "html")
        .otherwise("text")
    )


def image_type(content: Column) -> Column:
    """The kind of an image by its bytes; null if it is none that a browser shows."""
    head = F.hex(F.substring(content, 1, 12))
    start = F.ltrim(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return (
        F.when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("474946"), "image/gif")
        .when(head.startswith("FFD8"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("000001") | head.startswith("000002"), "image/x-icon")
        .when(start.startswith("<svg") | (start.startswith("<?xml") & start.contains("<svg")), "image/svg+xml")
    )


def renderable_image(declared: Column, content: Column, most: int = rules.LOGO_BYTES) -> Column:
    """Whether fetched bytes are worth keeping as a logo: an image by their declared type or by themselves, not empty, not too large."""
    said = F.coalesce(F.lower(declared).startswith("image/"), F.lit(False))
    sized = F.coalesce(F.length(content), F.lit(0)).between(1, most)
    return sized & (said | image_type(content).isNotNull())


def content_type_of(declared: Column, content: Column) -> Column:
    """The type to give a logo out under: what its bytes say, else the declared image type, else that of icons."""
    plain = F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1))))
    return F.coalesce(image_type(content), F.when(plain.startswith("image/"), plain), F.lit("image/x-icon"))


def retry_delay(attempt: Column, backoff_ms: Column) -> Column:
    """Milliseconds to wait after a failed attempt (from 1): twice as long each time; 2,000 at first where nothing is set."""
    return (F.coalesce(backoff_ms, F.lit(rules.BACKOFF_MS)) * F.pow(F.lit(2), attempt - 1)).cast("long")


def retried(attempt: Column, attempts: Column, kind: Column) -> Column:
    """Whether a failed attempt is followed by another: not the last one, and an error that may pass."""
    return (attempt < attempts) & F.coalesce(retryable(kind), F.lit(True))

"""Rulebook of the matcher: categories, synonyms, aliases, thresholds."""

from __future__ import annotations

# They decide results, and so stand as they are.
AUTO_ACCEPT, MIN_CANDIDATE = 85, 25
HIGH_POINTS, MEDIUM_POINTS, TEXT_SHARE = 18.0, 8.0, 0.75
MAX_PRICE = 5_000_000

# Category -> (keywords, gate, high, medium, ignore); the first category with a keyword wins.
CATEGORIES: dict[str, tuple[list[str], list[str], list[str], list[str], list[str]]] = {
    "accessory": (
        ["winder", "accessor", "cufflink", "strap", "gift", "care kit"],
        ["brand", "product_type"],
        ["model", "collection", "capacity"],
        ["material", "colour", "dimensions"],
        ["packaging", "gift_wrap", "engraving", "warranty"],
    ),
    "watch": (
        ["watch", "watches", "timepiece"],
        ["brand", "model", "collection"],
        ["case_size", "dial_colour", "case_material", "reference_number"],
        ["strap_material", "bracelet_material", "movement", "bezel_type"],
        ["water_resistance", "strap_length", "warranty", "packaging"],
    ),
    "ring": (
        ["ring", "rings", "engagement", "eternity", "bridal"],
        ["brand", "designer", "metal_type"],
        ["centre_stone", "carat_weight", "stone_cut"],
        ["diamond_colour", "diamond_clarity", "setting_style", "collection"],
        ["ring_size", "engraving", "gift_wrap"],
    ),
    "jewellery": (
        ["jewellery", "jewelry", "necklace", "bracelet", "earring", "pendant", "chain"],
        ["brand", "designer", "product_type", "metal_type"],
        ["gemstone", "carat_weight", "collection"],
        ["length", "drop", "chain_style", "clasp_type"],
        ["adjustable_length", "packaging"],
    ),
    "default": ([], ["brand"], ["collection", "metal_type", "gemstone"], ["carat_weight", "length"], ["packaging"]),
}

# Colour words in the order in which they are tried.
COLOURS = {
    "silver": "silver", "grey": "grey", "gray": "grey", "anthracite": "grey", "slate": "grey", "black": "black",
    "blue": "blue", "navy": "blue", "green": "green", "white": "white", "cream": "white", "ivory": "white",
    "champagne": "champagne", "gold": "gold", "rose": "rose", "pink": "pink", "brown": "brown", "chocolate": "brown",
}
MOTHER_OF_PEARL = r"mother\s*of\s*pearl|\bmop\b"

# Material patterns (case-insensitive) in the order in which they are tried.
MATERIALS = [
    (r"\boystersteel\b", "steel"),
    (r"\beverose\s*gold\b", "rose gold"),
    (r"\bcerachrom\b", "ceramic"),
    (r"\b(stainless\s*steel|steel)\b", "steel"),
    (r"\btwo[\s-]?tone\b", "two-tone"),
    (r"\b(18\s*ct|18k|18\s*carat)\s*(yellow)\s*gold\b", "18ct yellow gold"),
    (r"\b(18\s*ct|18k|18\s*carat)\s*(white)\s*gold\b", "18ct white gold"),
    (r"\b(18\s*ct|18k|18\s*carat)\s*(rose|red)\s*gold\b", "18ct rose gold"),
    (r"\b(9\s*ct|9k)\s*(yellow)\s*gold\b", "9ct yellow gold"),
    (r"\b(9\s*ct|9k)\s*(white)\s*gold\b", "9ct white gold"),
    (r"\b(9\s*ct|9k)\s*(rose|red)\s*gold\b", "9ct rose gold"),
    (r"\byellow\s*gold\b", "yellow gold"),
    (r"\bwhite\s*gold\b", "white gold"),
    (r"\b(rose|red)\s*gold\b", "rose gold"),
    (r"\bplatinum\b", "platinum"),
    (r"\btitanium\b", "titanium"),
    (r"\bceramic\b", "ceramic"),
    (r"\bleather\b", "leather"),
    (r"\brubber\b", "rubber"),
    (r"\b(nato|fabric|textile)\b", "fabric"),
    (r"\bsterling\s*silver\b", "sterling silver"),
]

# Movement patterns in the order in which they are tried.
MOVEMENTS = [
    (r"automatic|self[\s-]?winding|mechanical", "automatic"),
    (r"quartz|battery", "quartz"),
    (r"solar|eco[\s-]?drive", "solar"),
    (r"manual|hand[\s-]?wound", "manual"),
]

# Other names of attributes.
ALIASES = {
    "case_colour": "case_material", "casematerial": "case_material", "case_size_mm": "case_size", "casesize": "case_size",
    "case_diameter": "case_size", "dial_color": "dial_colour", "dialcolour": "dial_colour", "dial": "dial_colour",
    "strap": "strap_material", "strap_type": "strap_material", "bracelet": "bracelet_material", "band_material": "strap_material",
    "movement_type": "movement", "metal": "metal_type", "metal_colour": "metal_type", "stone": "centre_stone",
    "centre_stone_type": "centre_stone", "center_stone": "centre_stone", "carat": "carat_weight", "total_carat_weight": "carat_weight",
    "cut": "stone_cut", "stone_shape": "stone_cut", "clarity": "diamond_clarity", "colour_grade": "diamond_colour",
    "setting": "setting_style", "range": "collection", "collection_name": "collection", "series": "collection",
    "model_name": "model", "reference": "reference_number", "ref": "reference_number", "water_resistant": "water_resistance",
    "type": "product_type",
}

# Words that narrow nothing down in a shop's addresses.
STOP_WORDS = [
    "the", "and", "for", "with", "ct", "carat", "gold", "silver", "watch", "watches", "ring", "rings", "necklace", "bracelet",
    "earrings", "mens", "womens", "ladies", "new", "p", "product", "products", "jewellery", "jewelry", "uk", "com",
]

# Feed columns that are not attributes of a product.
NON_SPEC_COLUMNS = [
    "id", "title", "description", "google_product_category", "product_type", "link", "imagelink", "additional_image_link",
    "condition", "availability", "delivery_time", "price", "sale_price", "sale_price_effective_date", "price_visible",
    "brand", "gtin", "mpn", "offers", "item_group_id",
]

# Patterns that decide what a text says.
SIZE_MM = r"(?i)(\d{2}(?:\.\d)?)\s*mm"
SIZE_BARE = r"^\s*(\d{2}(?:\.\d)?)\s*$"
CARAT = r"(?i)(\d+(?:\.\d+)?)\s*(?:ct|carat)"
CARAT_BARE = r"^\s*(\d+(?:\.\d+)?)\s*$"
FRACTION = r"(\d)\s*/\s*(\d)"
DAMAGED_IDENTIFIER = r"(?i)^\d(\.\d+)?E\+\d+$"
GONE = r"outofstock|out of stock|sold\s*out|unavailable|discontinued"
THERE = "instock|in stock|available|limitedavailability|preorder|pre-order|backorder"
FIRST_NUMBER = r"(\d[\d.,\s]*\d|\d)"

# Where linked data and pages keep what a listing needs, in the order in which it is sought.
LINKED_HOLDERS = ["@graph", "offers", "mainEntity", "itemListElement", "hasVariant"]
LINKED_IDENTIFIERS = ["gtin13", "gtin", "gtin12", "gtin8", "mpn", "sku"]
LINKED_ATTRIBUTES = {"color": "dial_colour", "material": "case_material", "size": "case_size", "model": "model"}

# What users read for a tier, a run's mode, an error.
TIER_LABELS = {
    "ean_mpn_exact": "EAN/MPN exact", "brand_spec_attributes": "Brand + specs", "fuzzy_name_specs": "Fuzzy name", "manual": "Manually linked",
}
MODE_LABELS = {
    "prices": "Scrape prices for confirmed matches only",
    "discover": "Search for candidate matches for unmatched products",
    "both": "Look for new candidates, then scrape prices for confirmed matches",
}
ERROR_LABELS = {
    "robots_disallowed": "Blocked by robots.txt", "blocked": "Site actively blocked us", "not_found": "Listing 404s",
    "layout_changed": "Page layout changed", "no_price_found": "No price on the page", "implausible_price": "Price failed sanity check",
    "timeout": "Timed out", "http_error": "HTTP error", "navigation_failed": "Navigation failed", "brand_not_stocked": "Brand not stocked",
}

# Hues of brands, and from where on a confidence is high or middling.
BRAND_HUES = [265, 200, 158, 32, 340, 12, 190, 95]
TONE_HIGH, TONE_MID = 85, 55

# Statuses of matches and runs that a query may ask for.
MATCH_STATUSES = ["pending", "confirmed", "rejected"]
RUN_MODES = ["prices", "discover", "both"]

# What stands in the evidence of a score, and under which names it is stored.
INFERRED, NOT_PUBLISHED = "(inferred from listing title)", "(not published)"
NOTE_EXACT = "EAN/MPN exact match on %s — overrides attribute scoring."
NOTE_DIFFERS = "Competitor publishes EAN/MPN %s, which differs from ours (%s)."
NOTE_GATE = "Gate '%s' not published by competitor — treated as unknown."
NOTE_FUZZY = "No comparable spec attributes on the listing — fuzzy name match only."
EVIDENCE_NAMES = {
    "tier": "tier", "gates_passed": "gatesPassed", "gates_failed": "gatesFailed", "attribute_hits": "attributeHits",
    "attribute_misses": "attributeMisses", "name_similarity": "nameSimilarity", "notes": "notes",
}

# The largest logo kept, the wait before a second attempt, errors that an import lists.
LOGO_BYTES, BACKOFF_MS, IMPORT_ERRORS = 512 * 1024, 2000, 200
NO_TITLE, NO_PRICE = "title is missing", 'price "%s" could not be read'

"""The product feed: rows to products and prices, counters, and what an import changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import money, rules, text


def specs_of(columns: list[str]) -> Column:
    """The non-blank values of all columns that are attributes, under canonical names; of equal names the last column."""
    chosen: dict[str, str] = {}
    for c in columns:
        if c.lower() not in rules.NON_SPEC_COLUMNS and c != "row_number":
            name = "".join(x for x in "_".join(c.strip().lower().replace("-", " ").split()) if x.isalnum() or x == "_")
            chosen[rules.ALIASES.get(name, name)] = c
    if "item_group_id" in columns:
        chosen["item_group_id"] = "item_group_id"
    pairs = [y for name, c in chosen.items() for y in (F.lit(name), F.trim(F.col(f"`{c}`")))]
    every = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.map_filter(every, lambda _, v: F.coalesce(v, F.lit("")) != "")


def _at(rows: DataFrame) -> Callable[[str], Column]:
    """A feed column, trimmed; empty where the feed has none."""
    return lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")


def _kind(rows: DataFrame) -> Column:
    at = _at(rows)
    return (
        F.when(at("id") == "", "blank")
        .when(at("id") == "id", "header")
        .when(at("title") == "", "untitled")
        .when(F.upper(at("price_visible")) == "FALSE", "hidden")
        .when(money.feed_price(at("price")).isNull(), "unpriced")
        .otherwise("priced")
    )


def import_errors(rows: DataFrame, most: int = rules.IMPORT_ERRORS) -> DataFrame:
    """(row, id, error): the first rows of a feed that could not be taken as they are, and why."""
    at, kind = _at(rows), _kind(rows)
    error = F.when(kind == "untitled", rules.NO_TITLE).when(kind == "unpriced", F.format_string(rules.NO_PRICE, at("price")))
    found = rows.select(F.col("row_number").cast("long").alias("row"), at("id").alias("id"), error.alias("error")).where("error IS NOT NULL")
    return found.orderBy("row", "id").limit(most)


def parse(rows: DataFrame, now: Column, currency: str = "GBP") -> DataFrame:
    """A feed's rows as products with prices and flags.

    kind: blank, header (the header row again), untitled, hidden, unpriced or
    priced; only the last three are products.  A price on sale counts if it is
    lower and its window is open.
    """
    at, kind = _at(rows), _kind(rows)
    regular, sale = money.feed_price(at("price")), money.feed_price(at("sale_price"))
    cheaper = F.coalesce(sale < regular, F.lit(False))
    window = money.sale_window_open(at("sale_price_effective_date"), now)
    blank = lambda c: F.nullif(at(c), F.lit(""))
    priced = kind == "priced"
    return rows.select(
        *([F.col("row_number")] if "row_number" in rows.columns else []),
        kind.alias("kind"),
        at("id").alias("sku"),
        F.coalesce(blank("brand"), F.lit("Unknown")).alias("brand"),
        at("title").alias("title"),
        text.usable_identifier(at("gtin"), at("mpn")).alias("identifier"),
        blank("product_type").alias("category"),
        blank("link").alias("link"),
        specs_of(rows.columns).alias("specs"),
        F.coalesce(blank("availability"), F.lit("unknown")).alias("availability"),
        text.damaged_identifier(at("gtin")).alias("damaged_gtin"),
        text.damaged_identifier(at("mpn")).alias("damaged_mpn"),
        F.when(priced, F.when(cheaper & window, sale).otherwise(regular)).alias("price"),
        F.when(priced & cheaper & window, regular).alias("regular_price"),
        (priced & cheaper & window).alias("on_sale"),
        (priced & cheaper & ~window).alias("sale_not_yet_active"),
        F.when(priced, F.coalesce(money.feed_currency(at("price")), F.lit(currency))).alias("currency"),
    )


def counters(parsed: DataFrame) -> DataFrame:
    """One row of counts over a parsed feed."""
    n = lambda c: F.count_if(c)
    kind = F.col("kind")
    product = kind.isin("hidden", "unpriced", "priced")
    return parsed.agg(
        F.count("*").alias("total_rows"),
        n(kind == "blank").alias("skipped_blank"),
        n(kind == "header").alias("skipped_header"),
        n(kind.isin("untitled", "unpriced")).alias("failed"),
        n(product).alias("products"),
        n(kind == "priced").alias("prices"),
        n(kind == "hidden").alias("price_hidden"),
        n(F.col("on_sale")).alias("on_sale"),
        n(F.col("sale_not_yet_active")).alias("sale_not_yet_active"),
        n(product & F.col("damaged_gtin")).alias("damaged_gtin"),
        n(product & F.col("damaged_mpn")).alias("damaged_mpn"),
        n(product & F.col("identifier").isNotNull()).alias("with_identifier"),
    )


def products_of(parsed: DataFrame) -> DataFrame:
    """The feed's products, the last row of each SKU."""
    rows = parsed.where(F.col("kind").isin("hidden", "unpriced", "priced"))
    last = Window.partitionBy("sku").orderBy(F.desc("row_number"))
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def merge_specs(old: Column, new: Column) -> Column:
    """Both maps; the new one's values win."""
    old, new = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def upsert_products(products: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """The products after an import, with all columns they had and a column change: created, updated or kept.

    products: (internal_sku, brand, product_name, ean_mpn, category,
    our_product_url, specs, currency, source, delisted_at, updated_at, and perhaps
    id and others).  A known identifier stays where the feed has none; attributes
    are merged; a new product's id comes from its SKU.
    """
    products = products.drop("change")
    f = feed.select(F.col("sku"), *[F.col(c).alias(f"f_{c}") for c in ("brand", "title", "identifier", "category", "link", "specs", "currency")])
    both = products.join(f, products["internal_sku"] == f["sku"], "full_outer")
    fed, there = F.col("sku").isNotNull(), F.col("internal_sku").isNotNull()
    new = lambda a, b: F.when(fed, F.col(a)).otherwise(F.col(b))
    out = {
        "internal_sku": F.coalesce("internal_sku", "sku"),
        "brand": new("f_brand", "brand"),
        "product_name": new("f_title", "product_name"),
        "ean_mpn": F.coalesce("f_identifier", "ean_mpn"),
        "category": new("f_category", "category"),
        "our_product_url": new("f_link", "our_product_url"),
        "specs": F.when(fed, merge_specs(F.col("specs"), F.col("f_specs"))).otherwise(F.col("specs")),
        "currency": F.coalesce("f_currency", "currency", F.lit("GBP")),
        "source": F.coalesce("source", F.lit("feed")),
        "updated_at": F.when(fed, now).otherwise(F.col("updated_at")),
    }
    if "id" in products.columns:
        out["id"] = F.coalesce("id", F.xxhash64("sku").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))
    change = F.when(fed & there, "updated").when(fed, "created").otherwise("kept").alias("change")
    return both.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in products.columns], change)


def upsert_prices(prices: DataFrame, fed: DataFrame, fascia_id: int, import_id: int) -> DataFrame:
    """A site's prices after an import.  prices: (product_id, fascia_id, price, regular_price, on_sale, currency, feed_import_id)."""
    here, others = prices.where(F.col("fascia_id") == fascia_id), prices.where(F.col("fascia_id") != fascia_id)
    new = fed.select("product_id", F.lit(fascia_id).cast("long").alias("fascia_id"), "price", "regular_price", "on_sale", "currency", F.lit(import_id).cast("long").alias("feed_import_id"))
    kept = here.join(new.select("product_id"), "product_id", "left_anti").select(*prices.columns)
    return others.unionByName(kept).unionByName(new.select(*prices.columns))


def drop_stale_prices(prices: DataFrame, products: DataFrame, fascia_id: int, import_id: int) -> DataFrame:
    """Without a site's prices that the import did not write; manual products keep theirs."""
    manual = products.where("source = 'manual'").select(F.col("id").alias("product_id"), F.lit(True).alias("manual"))
    stale = (F.col("fascia_id") == fascia_id) & ~F.col("feed_import_id").eqNullSafe(F.lit(import_id)) & F.col("manual").isNull()
    return prices.join(manual, "product_id", "left").where(~stale).select(*prices.columns)


def relist(products: DataFrame, prices: DataFrame, now: Column) -> DataFrame:
    """delisted_at after an import: set where no site has a price (manual products excepted), cleared where one has."""
    priced = prices.select(F.col("product_id").alias("id")).distinct().withColumn("priced", F.lit(True))
    out = products.join(priced, "id", "left")
    gone = F.when(F.col("priced"), F.lit(None)).when(F.col("source") == "manual", F.col("delisted_at")).otherwise(F.coalesce("delisted_at", now))
    return out.withColumn("delisted_at", gone).drop("priced")


def run_import(
    snapshot: dict[str, DataFrame], rows: DataFrame, fascia_id: int, import_id: int, now: Column, filename: str | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """A feed import as a function from one snapshot (products, prices and perhaps imports) to the next, with its counters and the errors of its rows.

    keep: gives back the rows that it is given as read from where it wrote them. All
    results but the errors are made of the parsed feed, some of them several times:
    who wants more than one of them has it parsed once so.
    """
    parsed = parse(rows, now)
    parsed = keep(parsed) if keep else parsed
    feed = products_of(parsed)
    products = upsert_products(snapshot["products"], feed, now)
    ids = products.select("id", "internal_sku")
    fed = feed.where("kind = 'priced'").join(ids.select(F.col("id").alias("product_id"), F.col("internal_sku").alias("sku")), "sku")
    prices = drop_stale_prices(upsert_prices(snapshot["prices"], fed, fascia_id, import_id), products, fascia_id, import_id)
    listed = relist(products, prices, now)
    log = import_log(parsed, fed, snapshot["products"], listed, fascia_id, import_id, filename)
    if "imports" in snapshot:
        log = snapshot["imports"].unionByName(log, allowMissingColumns=True)
    return {"products": listed, "prices": prices, "counters": counters(parsed), "imports": log, "errors": import_errors(rows)}


def import_log(parsed: DataFrame, fed: DataFrame, before: DataFrame, after: DataFrame, fascia_id: int, import_id: int, filename: str | None = None) -> DataFrame:
    """One row about an import: rows read, products seen, prices written, products delisted by it."""
    seen = parsed.agg(F.count("*").alias("rows_read"), F.count_distinct(F.when(F.col("kind").isin("hidden", "unpriced", "priced"), F.col("sku"))).alias("products_seen"))
    written = fed.agg(F.count("*").alias("prices_written"))
    live = before.where(F.col("delisted_at").isNull()).select("internal_sku")
    gone = after.where(F.col("delisted_at").isNotNull()).join(live, "internal_sku", "left_semi").agg(F.count("*").alias("delisted"))
    head = [F.lit(import_id).cast("long").alias("id"), F.lit(fascia_id).cast("long").alias("fascia_id"), F.lit(filename).cast("string").alias("filename")]
    return seen.crossJoin(written).crossJoin(gone).select(*head, "rows_read", "products_seen", "prices_written", "delisted")

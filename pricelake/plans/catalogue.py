"""The registered queries of the price monitor, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.functions import labels, money, rules, text
from pricelake.operators import comparison as cmp
from pricelake.operators import feed, kept_counts, matching, mutations, pages, reports
from pricelake.plans import views as v
from pricelake.plans.oracle import VIEWS, r2
from pricelake.sources import competitors as shops
from pricelake.sources.shared import dealt_out, workspace
from pricelake.sources.snapshots import SnapshotLog
from pricelake.streaming import observations as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The site whose prices the comparison is made for.
SITE = 1
#: The clock of queries that need one.
NOW = "2026-08-09 12:00:00"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that follows the derived tables."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = VIEWS + sql
        return f

    return add


def _compared(s: SparkSession, d: str, **filters) -> DataFrame:
    own = cmp.filter_products(v.products(s, d), **filters)
    return cmp.comparison(own, v.fascia_prices(s, d), v.observations(s, d), v.competitors(s, d), SITE)


_ROW = ["id", "internal_sku", "brand", "product_name", "category", "currency", "our_price", "our_price_missing", "best_price", "best_competitor_id", "best_competitor", "position", "delta_abs", "delta_pct", "observed_at"]
_COLUMNS = ", ".join(_ROW)


@query(f"SELECT {_COLUMNS} FROM compared")
def comparison(s, d):
    return _compared(s, d).select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM compared WHERE lower(brand) = 'brand#7'")
def comparison_filtered_brand(s, d):
    return _compared(s, d, brand="BRAND#7").select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM compared WHERE lower(coalesce(category, '')) = 'economy'")
def comparison_filtered_category(s, d):
    return _compared(s, d, category="Economy").select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM compared WHERE product_name ILIKE '%red%' OR internal_sku ILIKE '%red%' OR brand ILIKE '%red%' OR coalesce(ean_mpn, '') ILIKE '%red%'")
def comparison_filtered_search(s, d):
    return _compared(s, d, search="red").select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM compared WHERE best_competitor_id = 3")
def comparison_filtered_competitor(s, d):
    return _compared(s, d).where("best_competitor_id = 3").select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM (SELECT * FROM compared ORDER BY brand NULLS LAST, product_name NULLS LAST, id LIMIT 200 OFFSET 100) WHERE position = 'lower'")
def comparison_page_position(s, d):
    own = cmp.product_page(cmp.filter_products(v.products(s, d)), 200, 100)
    rows = cmp.comparison(own, v.fascia_prices(s, d), v.observations(s, d), v.competitors(s, d), SITE)
    return cmp.at_position(rows, "lower").select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM compared WHERE position = 'higher'")
def comparison_filtered_position(s, d):
    return cmp.at_position(_compared(s, d), "higher").select(*_ROW)


@query(f"SELECT {_COLUMNS} FROM compared WHERE best_price IS NULL")
def comparison_filtered_unmatched(s, d):
    return cmp.at_position(_compared(s, d), "unmatched").select(*_ROW)


_SUMMARY = f"""SELECT count(*) AS products, count(*) FILTER (position = 'lower') AS lower, count(*) FILTER (position = 'equal') AS equal,
  count(*) FILTER (position = 'higher') AS higher, count(*) FILTER (best_price IS NULL) AS unmatched, count(*) FILTER (our_price_missing) AS awaiting_price,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE {r2("CAST(count(best_price) AS DOUBLE) / nullif(count(*), 0) * 100")} END AS coverage_pct FROM """


@query(_SUMMARY + "compared")
def comparison_summary_catalogue(s, d):
    return cmp.summary(_compared(s, d))


@query(_SUMMARY + "(SELECT * FROM compared ORDER BY brand NULLS LAST, product_name NULLS LAST, id LIMIT 200)")
def comparison_summary(s, d):
    own = cmp.product_page(cmp.filter_products(v.products(s, d)), 200)
    return cmp.summary(cmp.comparison(own, v.fascia_prices(s, d), v.observations(s, d), v.competitors(s, d), SITE))


def _seen(s, d):
    own = cmp.with_site_price(cmp.filter_products(v.products(s, d)), v.fascia_prices(s, d), SITE)
    return cmp.competitor_prices(own, cmp.latest_observations(v.observations(s, d)), v.competitors(s, d))


@query("SELECT product_id, competitor_id, competitor_name, price, was_price, promo, in_stock, observed_at, our_price, position, delta_abs, delta_pct, purchasable FROM seen")
def competitor_prices(s, d):
    return _seen(s, d)


@query("SELECT product_id, count(*) AS competitors, string_agg(CAST(competitor_id AS VARCHAR) || ':' || coalesce(position, '-'), ',' ORDER BY competitor_id) AS listing FROM seen GROUP BY product_id")
def competitor_prices_nested(s, d):
    entry = lambda e: F.concat(e["competitor_id"].cast("string"), F.lit(":"), F.coalesce(e["position"], F.lit("-")))
    rows = cmp.nested_prices(_seen(s, d))
    return rows.select("product_id", F.size("competitor_prices").cast("long").alias("competitors"), F.array_join(F.transform("competitor_prices", entry), ",").alias("listing"))


@query("SELECT product_id, competitor_id, run_id, line, price, was_price, promo, in_stock, observed_at FROM latest")
def latest_observation(s, d):
    return cmp.latest_observations(v.observations(s, d))


@query("SELECT o.product_id, competitor_id, display_name AS competitor_name, run_id, line, price, observed_at FROM observations o JOIN competitors c ON c.id = o.competitor_id WHERE product_id = 77 ORDER BY observed_at DESC, run_id DESC, line DESC LIMIT 200")
def product_history(s, d):
    return cmp.history(v.observations(s, d), v.competitors(s, d), 77).select("product_id", "competitor_id", "competitor_name", "run_id", "line", "price", "observed_at")


_EXPORT = """SELECT internal_sku, brand, product_name, category, ean_mpn, our_price, currency, best_competitor, best_price AS best_competitor_price, coalesce(position, 'unmatched') AS position,
  delta_abs AS delta_gbp, delta_pct, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS observed_at FROM compared ORDER BY brand NULLS LAST, product_name NULLS LAST, id LIMIT 500"""


@query(_EXPORT)
def comparison_export(s, d):
    own = cmp.product_page(cmp.filter_products(v.products(s, d)), 500)
    return cmp.export(cmp.comparison(own, v.fascia_prices(s, d), v.observations(s, d), v.competitors(s, d), SITE))


@query(f"""SELECT concat_ws(',', internal_sku, coalesce(brand, ''), CASE WHEN product_name LIKE '%,%' THEN '"' || product_name || '"' ELSE coalesce(product_name, '') END, coalesce(category, ''), coalesce(ean_mpn, ''),
  currency, coalesce(best_competitor, ''), position, coalesce(observed_at, '')) AS value FROM ({_EXPORT})""")
def comparison_export_lines(s, d):
    numbers = ("our_price", "best_competitor_price", "delta_gbp", "delta_pct")  # a double's shortest text is each engine's own
    return cmp.csv_lines(comparison_export(s, d).drop(*numbers))


@query(f"""SELECT p.*, (SELECT count(*) FROM compared) AS total FROM (SELECT {_COLUMNS} FROM compared ORDER BY brand NULLS LAST, product_name NULLS LAST, id LIMIT 50 OFFSET 20) p""")
def comparison_page_with_total(s, d):
    whole = cmp.filter_products(v.products(s, d))
    rows = cmp.comparison(cmp.product_page(whole, 50, 20), v.fascia_prices(s, d), v.observations(s, d), v.competitors(s, d), SITE)
    return cmp.with_total(rows.select(*_ROW), whole)


@query(f"""SELECT id, our_price, best_price, position, coalesce(n.confirmed, 0) AS confirmed, coalesce(n.pending, 0) AS pending, l.listing FROM compared c
  LEFT JOIN (SELECT product_id, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'pending') AS pending FROM matches GROUP BY product_id) n ON n.product_id = c.id
  LEFT JOIN (SELECT product_id, string_agg(CAST(competitor_id AS VARCHAR) || ':' || coalesce(position, '-'), ',' ORDER BY competitor_id) AS listing FROM seen GROUP BY product_id) l ON l.product_id = c.id""")
def comparison_full(s, d):
    own = cmp.filter_products(v.products(s, d))
    rows = cmp.comparison(own, v.fascia_prices(s, d), v.observations(s, d), v.competitors(s, d), SITE, v.matches(s, d), nested=True)
    entry = lambda e: F.concat(e["competitor_id"].cast("string"), F.lit(":"), F.coalesce(e["position"], F.lit("-")))
    return rows.select("id", "our_price", "best_price", "position", "confirmed", "pending", F.array_join(F.transform("competitor_prices", entry), ",").alias("listing"))


@query("SELECT product_id, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'pending') AS pending FROM matches GROUP BY product_id")
def match_counts(s, d):
    return cmp.match_counts(v.matches(s, d))


@query("""SELECT m.id, m.confidence, p.internal_sku, p.product_name, c.display_name AS competitor_name, f.price AS our_price, coalesce(f.currency, 'GBP') AS currency
  FROM matches m JOIN products p ON p.id = m.product_id JOIN competitors c ON c.id = m.competitor_id LEFT JOIN fascia_prices f ON f.product_id = p.id AND f.fascia_id = 1
  WHERE m.status = 'pending' ORDER BY confidence DESC, m.id LIMIT 200""")
def review_queue(s, d):
    rows = reports.review_queue(v.matches(s, d), v.products(s, d), v.competitors(s, d), v.fascia_prices(s, d), SITE)
    return rows.select("id", "confidence", "internal_sku", "product_name", "competitor_name", "our_price", "currency")


@query("""SELECT m.id, m.confidence, p.internal_sku, (SELECT count(*) FROM matches m JOIN products p ON p.id = m.product_id JOIN competitors c ON c.id = m.competitor_id WHERE m.status = 'confirmed') AS total
  FROM matches m JOIN products p ON p.id = m.product_id JOIN competitors c ON c.id = m.competitor_id WHERE m.status = 'confirmed' ORDER BY confidence DESC, m.id LIMIT 25""")
def review_page_with_total(s, d):
    rows = reports.review_queue(v.matches(s, d), v.products(s, d), v.competitors(s, d), v.fascia_prices(s, d), SITE, "confirmed", 25)
    known = v.matches(s, d).where("status = 'confirmed'").join(v.products(s, d).select(F.col("id").alias("product_id")), "product_id", "left_semi")
    known = known.join(v.competitors(s, d).select(F.col("id").alias("competitor_id")), "competitor_id", "left_semi")
    return cmp.with_total(rows.select("id", "confidence", "internal_sku"), known)


@query("SELECT DISTINCT 'brand' AS facet, brand AS value FROM products WHERE delisted_at IS NULL AND brand != '' UNION SELECT DISTINCT 'category', category FROM products WHERE delisted_at IS NULL AND category != ''")
def facets(s, d):
    return cmp.facets(v.products(s, d))


@query("SELECT id, internal_sku, brand, product_name FROM products WHERE delisted_at IS NULL AND (product_name ILIKE '%widget%' OR internal_sku ILIKE '%widget%' OR brand ILIKE '%widget%') ORDER BY brand, product_name, id LIMIT 100")
def product_list(s, d):
    own = cmp.filter_products(v.products(s, d), search="widget", fields=("product_name", "internal_sku", "brand"))
    return cmp.product_page(own, 100).select("id", "internal_sku", "brand", "product_name")


@query("SELECT * FROM fascias WHERE enabled ORDER BY code LIMIT 1")
def default_fascia(s, d):
    return cmp.default_fascia(v.fascias(s, d))


@query("""SELECT *, products - with_price AS awaiting_price FROM (
  SELECT count(*) FILTER (delisted_at IS NULL) AS products, count(*) FILTER (delisted_at IS NOT NULL) AS delisted, count(*) FILTER (delisted_at IS NULL AND source = 'manual') AS manual,
         count(DISTINCT lower(brand)) AS brands, max(updated_at) AS last_updated, (SELECT count(DISTINCT product_id) FROM fascia_prices) AS with_price FROM products)""")
def status_catalogue(s, d):
    return reports.catalogue_status(v.products(s, d), v.fascia_prices(s, d))


@query("SELECT count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected, count(DISTINCT product_id) FILTER (status = 'confirmed') AS products_matched FROM matches")
def status_matching(s, d):
    return reports.matching_status(v.matches(s, d))


@query("SELECT count(*) AS competitors, count(*) FILTER (enabled) AS enabled FROM competitors")
def status_competitors(s, d):
    return reports.competitor_status(v.competitors(s, d))


@query("SELECT count(*) AS observations, max(observed_at) AS last_observed FROM observations")
def status_observations(s, d):
    return reports.observation_status(v.observations(s, d))


@query("SELECT count(*) AS runs, max(started_at) AS last_started, (SELECT status FROM runs ORDER BY started_at DESC, id DESC LIMIT 1) AS last_status FROM runs")
def status_runs(s, d):
    return reports.run_status(v.runs(s, d))


@query("SELECT code, name, count(f.product_id) AS priced, (SELECT count(*) FROM products WHERE delisted_at IS NULL) - count(f.product_id) AS missing FROM fascias LEFT JOIN fascia_prices f ON f.fascia_id = fascias.id GROUP BY code, name")
def fascia_coverage(s, d):
    return reports.fascia_coverage(v.fascias(s, d), v.fascia_prices(s, d), v.products(s, d))


@query("SELECT code, name, (SELECT count(*) FROM fascia_prices f WHERE f.fascia_id = fascias.id) AS priced FROM fascias WHERE enabled")
def fascia_priced(s, d):
    return reports.fascia_priced(v.fascias(s, d), v.fascia_prices(s, d))


_NAMES = "LEFT JOIN products p ON p.id = r.product_id LEFT JOIN competitors c ON c.id = r.competitor_id"
_NAMED = "r.*, p.internal_sku, p.product_name, c.display_name AS competitor_name"


@query(f"SELECT {_NAMED} FROM runs r {_NAMES} ORDER BY r.started_at DESC, r.id DESC LIMIT 25")
def runs_recent(s, d):
    return reports.recent_runs(v.runs(s, d), v.products(s, d), v.competitors(s, d))


@query(f"SELECT {_NAMED} FROM items r {_NAMES} WHERE r.run_id = 42 ORDER BY (r.status = 'error') DESC, r.id LIMIT 500")
def run_items_error_first(s, d):
    return reports.items_errors_first(v.items(s, d), 42, v.products(s, d), v.competitors(s, d))


@query(f"SELECT {_NAMED} FROM items r {_NAMES} WHERE r.status = 'error' ORDER BY r.created_at DESC, r.id DESC LIMIT 100")
def errors_recent(s, d):
    return reports.recent_errors(v.items(s, d), v.products(s, d), v.competitors(s, d))


@query("SELECT run_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped FROM items GROUP BY run_id")
def run_counters(s, d):
    return reports.run_counters(v.items(s, d))


@query("""SELECT p.id AS product_id, c.id AS competitor_id FROM products p JOIN competitors c ON c.enabled AND (only_brand = '' OR lower(only_brand) = lower(brand))
  WHERE p.delisted_at IS NULL AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.product_id = p.id AND m.competitor_id = c.id AND m.status IN ('confirmed', 'pending'))""")
def discovery_worklist(s, d):
    return reports.discovery_worklist(v.products(s, d), v.competitors(s, d), v.matches(s, d))


@query("SELECT m.id, m.product_id, m.competitor_id, m.url, p.internal_sku FROM matches m JOIN products p ON p.id = m.product_id WHERE m.status = 'confirmed' AND p.delisted_at IS NULL")
def price_worklist(s, d):
    return reports.price_worklist(v.matches(s, d), v.products(s, d)).select("id", "product_id", "competitor_id", "url", "internal_sku")


@query("""SELECT p.id AS product_id, c.id AS competitor_id FROM products p JOIN competitors c ON c.enabled AND (only_brand = '' OR lower(only_brand) = lower(brand))
  WHERE p.delisted_at IS NULL AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.product_id = p.id AND m.competitor_id = c.id AND m.status IN ('confirmed', 'pending')) ORDER BY p.id, c.id LIMIT 40""")
def discovery_worklist_first(s, d):
    return reports.discovery_worklist(v.products(s, d), v.competitors(s, d), v.matches(s, d), limit=40)


@query("SELECT m.id, m.product_id, m.competitor_id FROM matches m JOIN products p ON p.id = m.product_id WHERE m.status = 'confirmed' AND p.delisted_at IS NULL ORDER BY m.id LIMIT 30")
def price_worklist_first(s, d):
    return reports.price_worklist(v.matches(s, d), v.products(s, d), limit=30).select("id", "product_id", "competitor_id")


@query("SELECT p.id AS product_id, c.id AS competitor_id FROM products p JOIN competitors c ON c.enabled AND only_brand != '' AND lower(only_brand) != lower(brand) WHERE p.delisted_at IS NULL")
def brand_not_stocked(s, d):
    return reports.brand_not_stocked(v.products(s, d), v.competitors(s, d))


@query("""SELECT coalesce(min(priced), 0) AS priced_everywhere, coalesce(bool_or(missing > 0), false) AS some_missing FROM (
  SELECT count(f.product_id) AS priced, (SELECT count(*) FROM products WHERE delisted_at IS NULL) - count(f.product_id) AS missing FROM fascias LEFT JOIN fascia_prices f ON f.fascia_id = fascias.id GROUP BY code)""")
def priced_everywhere(s, d):
    return reports.priced_everywhere(reports.fascia_coverage(v.fascias(s, d), v.fascia_prices(s, d), v.products(s, d)))


@query("SELECT competitor_id, count(*) AS urls FROM urls GROUP BY competitor_id")
def cached_urls(s, d):
    return reports.cached_urls(v.urls(s, d))


def _with_logos(s, d):
    """Shops, of which some have a logo."""
    null = lambda k: F.lit(None).cast(k)
    logo = F.when(F.col("id") % 2 == 0, F.col("slug").cast("binary"))
    return v.competitors(s, d).withColumns({"logo_data": logo, "logo_content_type": null("string"), "logo_url": null("string"), "logo_fetched_at": null("timestamp_ntz"), "logo_error": null("string")})


@query("SELECT id, display_name, id % 2 = 0 AS has_logo FROM competitors ORDER BY display_name, slug")
def competitor_list(s, d):
    return reports.competitor_list(_with_logos(s, d)).select("id", "display_name", "has_logo")


@query("SELECT count(*) AS competitors, count(*) FILTER (enabled) AS enabled, count(*) FILTER (id % 2 = 0) AS with_logo FROM competitors")
def competitor_logos(s, d):
    return reports.competitor_status(_with_logos(s, d))


def _tried(s, d):
    """What looking for logos found: of every third shop a picture, of every third a fault."""
    own = v.competitors(s, d).where("id % 3 != 0")
    got = F.col("id") % 3 == 1
    return own.select("slug", F.when(got, F.col("display_name").cast("binary")).alias("data"), F.when(got, "image/png").alias("content_type"), F.when(got, "u").alias("source"), F.when(~got, "none").alias("error"))


@query("""SELECT slug, CASE WHEN id % 3 = 1 THEN display_name WHEN id % 2 = 0 THEN slug END AS logo, CASE WHEN id % 3 = 1 THEN 'image/png' END AS logo_content_type, CASE WHEN id % 3 = 2 THEN 'none' END AS logo_error,
  CASE WHEN id % 3 = 1 THEN TIMESTAMP '2026-08-09 12:00:00' END AS logo_fetched_at FROM competitors""")
def logos_set(s, d):
    rows = mutations.set_logos(_with_logos(s, d), _tried(s, d), _now().cast("timestamp_ntz"))
    return rows.select("slug", F.col("logo_data").cast("string").alias("logo"), "logo_content_type", "logo_error", "logo_fetched_at")


@query("SELECT slug, CASE WHEN id % 2 = 0 AND slug != 'shop-2' THEN slug END AS logo FROM competitors")
def logo_clear(s, d):
    return mutations.clear_logo(_with_logos(s, d), "shop-2").select("slug", F.col("logo_data").cast("string").alias("logo"))


@query("SELECT count(*) FILTER (id % 3 = 1) AS fetched, count(*) FILTER (id % 3 = 2) AS failed, count(*) FILTER (id % 3 = 0) AS unchanged FROM competitors")
def logo_refresh(s, d):
    state = F.when(F.col("id") % 3 == 1, "fetched").when(F.col("id") % 3 == 2, "failed").otherwise("unchanged")
    return reports.logo_refresh(v.competitors(s, d).select(state.alias("status")))


# The feed.
_FEED = f""", feed AS (
  SELECT p_partkey AS row_number, CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'id' ELSE 'SKU-' || (p_partkey + p_partkey % 2 * 1000000) END AS sku,
         CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_name END AS title, p_retailprice AS regular, CASE WHEN p_partkey % 3 = 0 THEN 905.5 END AS sale, p_partkey % 6 = 0 AS later,
         p_partkey % 11 = 0 AS hidden, p_brand AS brand, p_type AS category, CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE 'M' || p_partkey END ELSE CAST(p_partkey + 7320000000000 AS VARCHAR) END AS identifier,
         p_partkey % 7 = 0 AS damaged_gtin, p_partkey % 14 = 0 AS damaged_mpn, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'in stock' END AS availability FROM part),
parsed AS (
  SELECT *, kind = 'priced' AND coalesce(sale < regular, false) AND NOT later AS on_sale, kind = 'priced' AND coalesce(sale < regular, false) AND later AS sale_not_yet_active FROM (
    SELECT *, CASE WHEN sku = '' THEN 'blank' WHEN sku = 'id' THEN 'header' WHEN title = '' THEN 'untitled' WHEN hidden THEN 'hidden' ELSE 'priced' END AS kind FROM feed))
"""


def _now():
    return F.lit(NOW).cast("timestamp")


def _parsed(s, d):
    return feed.parse(v.feed_rows(s, d), _now())


@query(_FEED + "SELECT row_number, kind, sku, brand, title, identifier, category, availability, damaged_gtin, damaged_mpn, CASE WHEN on_sale THEN sale WHEN kind = 'priced' THEN regular END AS price, CASE WHEN on_sale THEN regular END AS regular_price, on_sale, sale_not_yet_active, CASE WHEN kind = 'priced' THEN 'GBP' END AS currency FROM parsed")
def feed_parse(s, d):
    return _parsed(s, d).drop("specs", "link")


@query(_FEED + """SELECT count(*) AS total_rows, count(*) FILTER (kind = 'blank') AS skipped_blank, count(*) FILTER (kind = 'header') AS skipped_header, count(*) FILTER (kind = 'untitled') AS failed,
  count(*) FILTER (kind IN ('hidden', 'priced')) AS products, count(*) FILTER (kind = 'priced') AS prices, count(*) FILTER (kind = 'hidden') AS price_hidden, count(*) FILTER (on_sale) AS on_sale,
  count(*) FILTER (sale_not_yet_active) AS sale_not_yet_active, count(*) FILTER (kind IN ('hidden', 'priced') AND damaged_gtin) AS damaged_gtin,
  count(*) FILTER (kind IN ('hidden', 'priced') AND damaged_mpn) AS damaged_mpn, count(*) FILTER (kind IN ('hidden', 'priced') AND identifier IS NOT NULL) AS with_identifier FROM parsed""")
def feed_counters(s, d):
    return feed.counters(_parsed(s, d))


@query(_FEED + "SELECT availability AS value, count(*) AS n FROM feed GROUP BY 1")
def feed_availability(s, d):
    return reports.feed_histogram(v.feed_rows(s, d), "availability")


_AFTER = _FEED + """, fed AS (SELECT * FROM parsed WHERE kind IN ('hidden', 'priced')),
after AS (
  SELECT coalesce(p.internal_sku, f.sku) AS internal_sku, CASE WHEN f.sku IS NULL THEN p.product_name ELSE f.title END AS product_name, coalesce(f.identifier, p.ean_mpn) AS ean_mpn,
         CASE WHEN f.sku IS NULL THEN 'kept' WHEN p.internal_sku IS NULL THEN 'created' ELSE 'updated' END AS change, p.p_size AS old_size, f.row_number AS feed_row, p.id, p.source
  FROM products p FULL JOIN fed f ON f.sku = p.internal_sku)
"""


def _imported(s, d):
    return feed.upsert_products(v.products(s, d).drop("id"), feed.products_of(_parsed(s, d)), _now().cast("timestamp_ntz"))


@query(_AFTER + "SELECT internal_sku, product_name, ean_mpn, change, CASE WHEN change = 'created' THEN NULL ELSE CAST(old_size AS VARCHAR) END AS size, CASE WHEN change != 'kept' THEN (SELECT CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = feed_row) END AS case_size FROM after")
def feed_upsert_products(s, d):
    return _imported(s, d).select("internal_sku", "product_name", "ean_mpn", "change", F.try_element_at("specs", F.lit("size")).alias("size"), F.try_element_at("specs", F.lit("case_size")).alias("case_size"))


def _fed_prices(s, d):
    known = v.products(s, d).select(F.col("id").alias("product_id"), F.col("internal_sku").alias("sku"))
    return feed.products_of(_parsed(s, d)).where("kind = 'priced'").join(known, "sku")


_UPSERT = _FEED + """, fed AS (SELECT p.id AS product_id, CASE WHEN on_sale THEN sale ELSE regular END AS price FROM parsed f JOIN products p ON p.internal_sku = f.sku WHERE kind = 'priced'),
upserted AS (
  SELECT product_id, fascia_id, price, feed_import_id FROM fascia_prices f WHERE fascia_id != 1 OR product_id NOT IN (SELECT product_id FROM fed)
  UNION ALL SELECT product_id, CAST(1 AS BIGINT), price, CAST(3 AS BIGINT) FROM fed)
"""


def _upserted(s, d):
    return feed.upsert_prices(v.fascia_prices(s, d), _fed_prices(s, d), SITE, 3)


@query(_UPSERT + "SELECT * FROM upserted")
def feed_upsert_prices(s, d):
    return _upserted(s, d).select("product_id", "fascia_id", "price", "feed_import_id")


_KEPT = _UPSERT + ", kept AS (SELECT u.* FROM upserted u JOIN products p ON p.id = u.product_id WHERE NOT (fascia_id = 1 AND feed_import_id IS DISTINCT FROM 3 AND source != 'manual'))\n"


def _kept(s, d):
    return feed.drop_stale_prices(_upserted(s, d), v.products(s, d), SITE, 3)


@query(_KEPT + "SELECT * FROM kept")
def feed_stale(s, d):
    return _kept(s, d).select("product_id", "fascia_id", "price", "feed_import_id")


@query(_KEPT + "SELECT id, CASE WHEN id IN (SELECT product_id FROM kept) THEN NULL WHEN source = 'manual' THEN delisted_at ELSE coalesce(delisted_at, TIMESTAMP '2026-08-09 12:00:00') END AS delisted_at FROM products")
def feed_relist(s, d):
    return feed.relist(v.products(s, d), _kept(s, d), _now().cast("timestamp_ntz")).select("id", "delisted_at")


@query(_KEPT + "SELECT id FROM products WHERE delisted_at IS NULL AND source != 'manual' AND id NOT IN (SELECT product_id FROM kept)")
def feed_delist(s, d):
    after = feed.relist(v.products(s, d), _kept(s, d), _now().cast("timestamp_ntz"))
    live = v.products(s, d).where("delisted_at IS NULL").select("id")
    return after.where("delisted_at IS NOT NULL").join(live, "id", "left_semi").select("id")


_LOG = _AFTER.rstrip() + """, fed2 AS (SELECT p.id AS product_id FROM parsed f JOIN products p ON p.internal_sku = f.sku WHERE kind = 'priced'),
kept2 AS (SELECT product_id FROM fascia_prices f JOIN products p ON p.id = f.product_id WHERE (fascia_id != 1 OR source = 'manual' OR feed_import_id = 3) UNION SELECT product_id FROM fed2)
"""


@query(_LOG + """SELECT CAST(3 AS BIGINT) AS id, CAST(1 AS BIGINT) AS fascia_id, 'feed.tsv' AS filename, (SELECT count(*) FROM feed) AS rows_read, (SELECT count(DISTINCT sku) FROM fed) AS products_seen,
  (SELECT count(*) FROM parsed WHERE kind = 'priced') AS prices_written, (SELECT count(*) FROM products WHERE delisted_at IS NULL AND source != 'manual' AND id NOT IN (SELECT product_id FROM kept2)) AS delisted""")
def feed_import_log(s, d):
    state = {"products": v.products(s, d), "prices": v.fascia_prices(s, d)}
    return feed.run_import(state, v.feed_rows(s, d), SITE, 3, _now().cast("timestamp_ntz"), "feed.tsv")["imports"]


# Changes of state.
@query("""SELECT product_id, competitor_id, CASE WHEN (product_id + competitor_id) % 4 = 0 THEN CAST((product_id + competitor_id) % 101 AS INTEGER) ELSE confidence END AS confidence,
  CASE WHEN (product_id + competitor_id) % 4 = 0 AND NOT (coalesce(confirmed_by, 'auto') != 'auto' OR status = 'rejected') THEN CASE WHEN (product_id + competitor_id) % 101 >= 85 THEN 'confirmed' ELSE 'pending' END ELSE status END AS status,
  confirmed_by FROM matches""")
def match_upsert(s, d):
    old = v.matches(s, d, spread=True)
    again = (F.col("product_id") + F.col("competitor_id")).alias("n")
    new = old.select("product_id", "competitor_id", "url", again).where("n % 4 = 0").withColumn("confidence", (F.col("n") % 101).cast("int")).withColumn("tier", F.lit("fuzzy_name_specs"))
    new = new.withColumn("status", F.when(F.col("confidence") >= rules.AUTO_ACCEPT, "confirmed").otherwise("pending"))
    return mutations.upsert_matches(old, new).select("product_id", "competitor_id", "confidence", "status", "confirmed_by")


_TWO = """, two AS (
  SELECT product_id, competitor_id, url || '/' || k AS url, k, CASE WHEN k = 1 AND product_id % 3 = 0 THEN 'confirmed' WHEN k = 2 AND product_id % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status,
         CASE WHEN k = 1 AND product_id % 3 = 0 THEN CASE WHEN product_id % 2 = 0 THEN 'auto' ELSE 'kim' END END AS confirmed_by,
         (product_id * k + competitor_id) % 30 + 75 AS confidence FROM (SELECT DISTINCT product_id, competitor_id, url FROM matches), (VALUES (1), (2)) t(k)),
asked AS (SELECT *, confidence >= 85 AND NOT (coalesce(confirmed_by, 'auto') != 'auto' OR status = 'rejected') AS asks FROM two)
"""


@query(_TWO + """SELECT product_id, competitor_id, url, CAST(confidence AS INTEGER) AS confidence,
  CASE WHEN coalesce(confirmed_by, 'auto') != 'auto' OR status = 'rejected' THEN status
       WHEN NOT asks THEN 'pending'
       WHEN product_id % 3 = 0 THEN CASE WHEN k = 1 THEN 'confirmed' ELSE 'pending' END
       WHEN row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY asks DESC, confidence DESC, url) = 1 THEN 'confirmed' ELSE 'pending' END AS status FROM asked""")
def match_upsert_two_listings(s, d):
    """Two listings of every pair, both scored again: at most one new confirmation, none beside an old one."""
    p, k = F.col("product_id"), F.col("k")
    old = v.matches(s, d, spread=True).select("product_id", "competitor_id", "url", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    first = (k == 1) & (p % 3 == 0)
    old = old.withColumns({"url": F.concat("url", F.lit("/"), k.cast("string")), "confidence": F.lit(0), "tier": F.lit("manual")})
    old = old.withColumn("status", F.when(first, "confirmed").when((k == 2) & (p % 5 == 0), "rejected").otherwise("pending"))
    old = old.withColumn("confirmed_by", F.when(first, F.when(p % 2 == 0, "auto").otherwise("kim")))
    new = old.withColumn("confidence", ((p * k + F.col("competitor_id")) % 30 + 75).cast("int"))
    new = new.withColumn("status", F.when(F.col("confidence") >= rules.AUTO_ACCEPT, "confirmed").otherwise("pending"))
    return mutations.upsert_matches(old, new).select("product_id", "competitor_id", "url", "confidence", "status")


@query("""SELECT id, internal_sku, coalesce(ean_mpn, '') AS ean_mpn, source, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS reference FROM products
  UNION ALL SELECT (SELECT max(id) + 1 FROM products), 'new-1', '761', 'manual', 12.5, 'R-9'""")
def manual_product(s, d):
    own, prices = mutations.add_manual_product(v.products(s, d), v.fascia_prices(s, d).where("false"), "new-1", "B", "N", 12.5, SITE, identifier=" 761 ", reference="R-9")
    rows = own.join(prices.select(F.col("product_id").alias("id"), "price"), "id", "left")
    return rows.select("id", "internal_sku", F.coalesce("ean_mpn", F.lit("")).alias("ean_mpn"), "source", "price", F.try_element_at("specs", F.lit("reference_number")).alias("reference"))


@query("SELECT id, CASE WHEN id = (SELECT min(id) FROM matches WHERE status = 'pending') THEN 'confirmed' ELSE status END AS status, CASE WHEN id = (SELECT min(id) FROM matches WHERE status = 'pending') THEN 'ana' ELSE confirmed_by END AS confirmed_by FROM matches")
def match_confirm(s, d):
    rows = v.matches(s, d)
    first = rows.where("status = 'pending'").agg(F.min("id")).first()[0]
    return mutations.confirm_match(rows, first, "ana", _now().cast("timestamp_ntz")).select("id", "status", "confirmed_by")


@query("SELECT id, CASE WHEN id = (SELECT max(id) FROM matches) THEN 'rejected' ELSE status END AS status FROM matches")
def match_reject(s, d):
    rows = v.matches(s, d)
    return mutations.reject_match(rows, rows.agg(F.max("id")).first()[0]).select("id", "status")


@query("""SELECT 'products' AS "table", count(*) AS removed FROM products WHERE id % 10 = 0 UNION ALL SELECT 'matches', count(*) FROM matches WHERE product_id % 10 = 0
  UNION ALL SELECT 'observations', count(*) FROM observations WHERE product_id % 10 = 0 UNION ALL SELECT 'prices', count(*) FROM fascia_prices WHERE product_id % 10 = 0""")
def delete_product_cascade(s, d):
    tables = {"products": v.products(s, d), "matches": v.matches(s, d), "observations": v.observations(s, d), "prices": v.fascia_prices(s, d)}
    return mutations.removed(tables, mutations.delete_products(tables, v.products(s, d).where("id % 10 = 0")))


_GONE = "(SELECT id FROM runs WHERE id % 7 = 0 AND status != 'running')"


@query(f"SELECT product_id, competitor_id, line, price, observed_at, CASE WHEN run_id NOT IN {_GONE} THEN run_id END AS run_id FROM observations")
def delete_run_keep_observations(s, d):
    _, _, seen = mutations.delete_runs(v.runs(s, d), v.items(s, d), v.observations(s, d), v.runs(s, d).where("id % 7 = 0"))
    return seen.select("product_id", "competitor_id", "line", "price", "observed_at", "run_id")


@query(f"SELECT id, run_id, status FROM items WHERE run_id NOT IN {_GONE}")
def delete_run_items(s, d):
    _, left, _ = mutations.delete_runs(v.runs(s, d), v.items(s, d), v.observations(s, d), v.runs(s, d).where("id % 7 = 0"))
    return left.select("id", "run_id", "status")


@query("SELECT product_id, competitor_id, status FROM matches WHERE NOT (competitor_id = 3 AND status != 'rejected')")
def remove_competitor_price(s, d):
    return mutations.remove_competitor_price(v.observations(s, d), v.matches(s, d), competitor_id=3)[1].select("product_id", "competitor_id", "status")


@query("SELECT competitor_id, url, slug, TIMESTAMP '2024-01-01 00:00:00' AS first_seen_at, CASE WHEN competitor_id % 2 = 0 THEN TIMESTAMP '2026-08-09 12:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_seen_at FROM urls")
def url_cache_upsert(s, d):
    before = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = v.urls(s, d).withColumns({"first_seen_at": before, "last_seen_at": before})
    return mutations.upsert_urls(old, v.urls(s, d).where("competitor_id % 2 = 0"), _now().cast("timestamp_ntz"))


@query("SELECT slug, CASE WHEN id % 2 = 0 THEN upper(display_name) ELSE display_name END AS display_name, base_url, enabled FROM competitors")
def competitor_sync(s, d):
    old = v.competitors(s, d)
    files = old.where("id % 2 = 0").withColumn("display_name", F.upper("display_name")).withColumn("enabled", F.lit(True))
    return mutations.sync_competitors(old, files).select("slug", "display_name", "base_url", "enabled")


# Texts, identifiers, attributes.
_NORM = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({}), '[‘’“”]', '''', 'g'), '&', ' and '), '[^a-z0-9.\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalise_text(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.normalise_text(F.col("text"))).alias("digest"))


@query("SELECT id, regexp_replace(lower(brand || '/' || internal_sku), '[^a-z0-9]', '', 'g') AS identifier FROM products")
def normalise_identifier(s, d):
    return v.products(s, d).select("id", text.normalise_identifier(F.concat("brand", F.lit("/"), "internal_sku")).alias("identifier"))


def _samples(s, d, values: list[str]) -> DataFrame:
    """A row for each product: one of the values, by its number."""
    pick = F.get(F.array(*[F.lit(x) for x in values]), (F.col("id") % len(values)).cast("int"))
    return v.products(s, d).select("id", pick.alias("value"))


def _cases(name: str, f, cases: list[tuple[str, object]], kind: str) -> None:
    """Registers a scalar function over the products, its answers being written out in the SQL."""

    def run(s, d):
        return _samples(s, d, [x for x, _ in cases]).select("id", f(F.col("value")).alias("answer"))

    answer = lambda a: "NULL" if a is None else repr(a) if kind != "VARCHAR" else "'" + a.replace("'", "''") + "'"
    list_sql = ", ".join(answer(a) for _, a in cases)
    query(f"SELECT id, CAST(([{list_sql}])[CAST(id % {len(cases)} AS INTEGER) + 1] AS {kind}) AS answer FROM products", name)(run)


_cases("case_size", text.case_size, [("41mm", "41"), ("41 mm", "41"), ("40.5 MM", "40.5"), ("39", "39"), ("large", None), ("case 36.0mm", "36")], "VARCHAR")
_cases("colour", text.colour, [("Navy Blue", "blue"), ("Mother of Pearl", "mother of pearl"), ("rose gold", "gold"), ("Anthracite", "grey"), ("MOP dial", "mother of pearl"), ("Teal", "teal")], "VARCHAR")
_cases("material", text.material, [("Stainless Steel", "steel"), ("18ct Rose Gold", "18ct rose gold"), ("18 carat red gold", "18ct rose gold"), ("Everose gold", "rose gold"), ("Two-Tone", "two-tone"), ("Brass & wood", "brass and wood")], "VARCHAR")
_cases("carat", text.carat, [("0.50ct", "0.5"), ("1/2 carat", "0.5"), ("1.00 ct", "1"), ("2", "2"), ("none", None), ("3/0 2ct", "2")], "VARCHAR")
_cases("movement", text.movement, [("Self-winding", "automatic"), ("Quartz (battery)", "quartz"), ("Eco-Drive", "solar"), ("Hand wound", "manual"), ("Tourbillon", "tourbillon")], "VARCHAR")
_cases("canonical_attribute", text.canonical_attribute, [("Dial Color", "dial_colour"), (" strap-type ", "strap_material"), ("Case Size (mm)", "case_size"), ("ref", "reference_number"), ("Warranty!", "warranty")], "VARCHAR")
_cases("category_rules", text.category_of, [("Watch winders", "accessory"), ("Men's Watches", "watch"), ("Earrings", "ring"), ("Necklaces", "jewellery"), ("Vases", "default"), ("", "default")], "VARCHAR")
_cases("parse_price", money.parse_price, [("£1,234.00", 1234.0), ("From £2,499.99", 2499.99), ("1.234,56", 1234.56), ("£1,234", 1.23), ("POA", None), ("", None), ("£950", 950.0)], "DOUBLE")
_cases("availability", text.availability, [("In Stock", True), ("https://schema.org/OutOfStock", False), ("Sold  out", False), ("Pre-order", True), ("Ask us", None)], "BOOLEAN")
_cases("damaged_identifier", text.damaged_identifier, [("7.32E+11", True), ("5e+12", True), ("7320000000123", False), ("6161 WG", False), ("", False)], "BOOLEAN")
_cases("initials", text.initials, [("Ernest Jones", "EJ"), ("Beaverbrooks", "B"), ("77 Diamonds", "7D"), ("Berry's Jewellers", "BJ"), ("--", "?")], "VARCHAR")
_cases("delimiter", text.detect_delimiter, [("a,b;c,d", ","), ("a\tb\tc,d", "\t"), ("a;b;c", ";"), ("a|b", "|"), ("abc", ",")], "VARCHAR")
_cases("sale_window", lambda x: money.sale_window_open(x, F.lit("2026-08-09 12:00:00+00:00").cast("timestamp")), [("", True), ("2026-08-01T00:00:00Z/2026-08-31T00:00:00Z", True), ("2026-09-01T00:00:00Z/", False), ("/2026-08-01T00:00:00Z", False), ("soon/later", True), ("2026-08-09T08:00:00-03:00/2026-08-09T10:00:00-03:00", True)], "BOOLEAN")


@query("SELECT id, CASE s WHEN 0 THEN NULL WHEN 1 THEN 'not_found' WHEN 2 THEN 'not_found' WHEN 3 THEN 'blocked' WHEN 4 THEN 'http_error' ELSE 'http_error' END AS kind, CASE WHEN s = 0 THEN NULL ELSE s > 3 END AS again FROM (SELECT id, id % 6 AS s FROM products)")
def error_kind(s, d):
    status = F.get(F.array(*[F.lit(x) for x in (200, 404, 410, 429, 500, 418)]), (F.col("id") % 6).cast("int"))
    rows = v.products(s, d).select("id", text.error_kind(status).alias("kind"))
    return rows.withColumn("again", text.retryable(F.col("kind")))


@query(rf"""SELECT doc_id, item_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END AS similarity FROM (
  SELECT doc_id, item_id, list_distinct(list_filter(string_split({_NORM.format('d.text')}, ' '), lambda x: x != '')) AS a, list_distinct(list_filter(string_split({_NORM.format('b.text')}, ' '), lambda x: x != '')) AS b
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)""")
def name_similarity(s, d):
    # Words are cut on either side before the join, once a text.
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("x"))
    items = s.read.parquet(f"{d}/benchmark.parquet").select("item_id", text.tokens(F.col("text")).alias("y"))
    pairs = docs.join(items, F.col("item_id") == F.col("doc_id") % 40)
    return pairs.select("doc_id", "item_id", text.dice(F.col("x"), F.col("y")).alias("similarity"))


@query(r"SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '[^a-z0-9]+', ' ', 'g')) AS words FROM pages")
def slug_words(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", text.slug_words(F.col("url")).alias("words"))


_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_TERMS = f""", terms AS (
  SELECT id AS product_id, word AS term, row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, min(i)) AS place FROM (
    SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
      SELECT id, string_split(regexp_replace(lower(brand || ' ' || product_name || coalesce(' ' || ean_mpn, '')), '[^a-z0-9]+', ' ', 'g'), ' ') AS words FROM products))
  WHERE length(word) > 1 AND word NOT IN ({_STOP}) GROUP BY id, word QUALIFY place <= 8)
"""


def _terms(s, d):
    return v.products(s, d).select(F.col("id").alias("product_id"), text.search_terms(F.col("brand"), F.col("product_name"), F.col("ean_mpn")).alias("terms"))


@query(_TERMS + "SELECT product_id, string_agg(term, ' ' ORDER BY place) AS terms FROM terms GROUP BY product_id")
def search_terms(s, d):
    return _terms(s, d).where(F.size("terms") > 0).select("product_id", F.array_join("terms", " ").alias("terms"))


@query(_TERMS + f""", hits AS (
  SELECT t.product_id, u.competitor_id, u.url, {r2("sum(CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 1.25 ELSE 1.3611111111 END) * 1000")} AS rank FROM terms t
  JOIN (SELECT competitor_id, url, term, count(*) AS n FROM (SELECT competitor_id, url, unnest(string_split(slug, ' ')) AS term FROM urls) GROUP BY ALL) u ON u.term = t.term GROUP BY ALL)
SELECT product_id, competitor_id, url, rank, row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY rank DESC, length(url), url) AS place FROM hits QUALIFY place <= 5""")
def candidate_urls(s, d):
    found = matching.candidate_urls(_terms(s, d), v.urls(s, d))
    return found.select("product_id", "competitor_id", "url", money.round2(F.col("rank") * 1000).alias("rank"), F.col("place").cast("long").alias("place"))


# Scores by the rules of the three kinds of product, worked out from the columns: watches ask for brand, size and dial, rings
# for brand and metal (nothing to weigh), others for brand, and weigh the metal.
_WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda x: x != ''))"
_SCORED = f""", pairs AS (
  SELECT a.id, b.id AS other, a.id % 3 AS kind, a.id % 5 AS metal, a.brand, b.brand AS listing_brand, a.ean_mpn, CASE a.id % 49 WHEN 0 THEN a.ean_mpn WHEN 1 THEN 'X-999' END AS listing_ean,
         {_NORM.format("a.brand || ' ' || a.product_name")} AS ours, {_NORM.format("b.brand || ' ' || b.product_name || ' ' || b.p_size || 'mm'")} AS title, a.p_size, b.p_size AS listed_size
  FROM products a JOIN products b ON b.id = a.id + CASE WHEN a.id % 4 = 0 THEN 0 ELSE 1 END),
worded AS (SELECT *, {_NORM.format('brand')} AS x, {_NORM.format('listing_brand')} AS y, {_WORDS.format('ours')} AS v, {_WORDS.format('title')} AS w FROM pairs),
judged AS (
  SELECT *, coalesce(ean_mpn = listing_ean, false) AS exact, coalesce(ean_mpn != listing_ean, false) AS conflict, contains(x, y) OR contains(y, x) AS brand_ok,
         contains(title, 'platinum') AS named, kind = 0 AND p_size >= 10 AS sized, listed_size >= 10 AS said,
         CASE WHEN len(v) = 0 OR len(w) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(v, w)) / (len(v) + len(w)) END AS same FROM worded),
gated AS (
  SELECT *, CASE WHEN exact THEN '' WHEN conflict THEN 'ean_mpn' WHEN NOT brand_ok THEN 'brand' WHEN kind = 1 AND metal IN (1, 2) THEN 'metal_type' ELSE '' END AS gates_failed,
         CASE kind WHEN 0 THEN 18 + CASE WHEN sized AND said THEN 18 ELSE 0 END WHEN 1 THEN 0 ELSE CASE WHEN metal IN (0, 2) OR named THEN 18 ELSE 0 END END AS available,
         CASE kind WHEN 0 THEN 18 + CASE WHEN sized AND said AND p_size = listed_size THEN 18 ELSE 0 END WHEN 1 THEN 0 ELSE CASE WHEN metal = 0 THEN 18 WHEN metal != 2 AND named THEN 13.5 ELSE 0 END END AS earned FROM judged),
scored AS (
  SELECT *, NOT exact AND gates_failed = '' AS weighed, CASE WHEN exact THEN 100 WHEN gates_failed != '' THEN 0 WHEN available > 0 THEN floor(CAST(earned AS DOUBLE) / available * 100 * 0.8::DOUBLE + same * 100 * 0.2::DOUBLE + 0.5)
         ELSE floor(least(same * 100, 80.0) + 0.5) END AS confidence FROM gated)
SELECT id, other, CAST(confidence AS INTEGER) AS confidence, CASE WHEN exact THEN 'ean_mpn_exact' WHEN weighed AND available = 0 THEN 'fuzzy_name_specs' ELSE 'brand_spec_attributes' END AS tier,
  exact OR (weighed AND confidence >= 25) AS viable, exact OR (weighed AND confidence >= 85) AS auto_accept, gates_failed,
  CASE WHEN exact OR gates_failed IN ('ean_mpn', 'brand') THEN '' WHEN kind = 1 AND gates_failed = '' AND (metal = 0 OR named) THEN 'brand,metal_type' ELSE 'brand' END AS gates_passed,
  CASE WHEN NOT weighed OR kind = 1 THEN '' WHEN kind = 0 THEN 'dial_colour=navy' || CASE WHEN sized AND said AND p_size = listed_size THEN ',case_size=' || listed_size || 'mm' ELSE '' END
       WHEN metal = 0 THEN 'metal_type=platinum 950' WHEN metal != 2 AND named THEN 'metal_type=(inferred from listing title)' ELSE '' END AS hits,
  CASE WHEN NOT weighed OR kind = 1 OR (kind = 0 AND NOT sized) THEN '' WHEN kind = 0 THEN CASE WHEN NOT said THEN 'case_size=(not published)' WHEN p_size != listed_size THEN 'case_size=' || listed_size || 'mm' ELSE '' END
       WHEN metal = 2 THEN 'metal_type=titanium' WHEN metal != 0 AND NOT named THEN 'metal_type=(not published)' ELSE '' END AS misses,
  CASE WHEN weighed THEN round(same, 3) END AS name_similarity,
  CASE WHEN exact THEN 'EAN/MPN exact match on ' || ean_mpn || ' — overrides attribute scoring.' WHEN conflict THEN 'Competitor publishes EAN/MPN ' || listing_ean || ', which differs from ours (' || ean_mpn || ').'
       WHEN NOT weighed THEN '' ELSE concat_ws('|', CASE WHEN kind = 1 AND metal > 2 AND NOT named THEN 'Gate ''metal_type'' not published by competitor — treated as unknown.' END,
       CASE WHEN available = 0 THEN 'No comparable spec attributes on the listing — fuzzy name match only.' END) END AS notes FROM scored"""


@query(_SCORED)
def score_candidates(s, d):
    k, size = F.col("id"), F.concat(F.col("specs")["size"], F.lit("mm"))
    own = dealt_out(v.products(s, d), "id").withColumn("specs", F.create_map(F.lit("Dial"), F.lit("Blue"), F.lit("case size"), size, F.lit("metal"), F.lit("Platinum")))
    listing = own.select(k.alias("other"), F.concat_ws(" ", "brand", "product_name", F.col("specs")["case size"]).alias("title"), F.col("brand").alias("listing_brand"))
    pairs = own.withColumn("other", k + F.when(k % 4 == 0, 0).otherwise(1)).join(listing.hint("merge"), "other")
    metal = F.when(k % 5 == 0, "platinum 950").when(k % 5 == 1, "!!").when(k % 5 == 2, "titanium")
    pairs = pairs.withColumns({
        "listing_ean": F.when(k % 49 == 0, F.col("ean_mpn")).when(k % 49 == 1, "X-999"),
        "attributes": F.create_map(F.lit("dial_colour"), F.lit("navy"), F.lit("case_size"), F.lit(" "), F.lit("Metal Colour"), metal),
        "category": F.when(k % 3 == 0, "Watches").when(k % 3 == 1, "Engagement Rings"),
    })
    e = F.col("evidence")
    said = lambda c: F.array_join(F.transform(e[c], lambda x: F.concat(x["attribute"], F.lit("="), x["theirs"])), ",")
    return matching.score_candidates(pairs).select(
        "id", "other", "confidence", "tier", "viable", "auto_accept", F.array_join(e["gates_failed"], ",").alias("gates_failed"), F.array_join(e["gates_passed"], ",").alias("gates_passed"),
        said("attribute_hits").alias("hits"), said("attribute_misses").alias("misses"), e["name_similarity"].alias("name_similarity"), F.array_join(e["notes"], "|").alias("notes"),
    )


# The same functions over whole tables: the SQL computes the answers from the columns.
def _case(pairs, otherwise: str) -> str:
    """SQL for the name of the first pattern that a text matches."""
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{name}'" for x, p, name in pairs) + f" ELSE {otherwise} END"


def _over_documents(name: str, f, sql: str, kind: str | None = None) -> None:
    """Registers a function over the documents' texts; long answers are compared by their digest."""
    answer = (lambda x: F.md5(x)) if kind is None else (lambda x: x)

    def run(s, d):
        return s.read.parquet(f"{d}/documents.parquet").select("doc_id", answer(f(F.col("text"))).alias("answer"))

    query(f"WITH normal AS (SELECT doc_id, text, {_NORM.format('text')} AS norm FROM documents) SELECT doc_id, {f'md5({sql})' if kind is None else sql} AS answer FROM normal".replace("WITH", ",", 1), name)(run)


_over_documents("colour_of_texts", text.colour, _case([("norm", rules.MOTHER_OF_PEARL, "mother of pearl"), *(("norm", rf"\b{w}\b", n) for w, n in rules.COLOURS.items())], "norm"))
_over_documents("material_of_texts", text.material, _case([("text", f"(?i){p}", n) for p, n in rules.MATERIALS], "norm"))
_over_documents("movement_of_texts", text.movement, _case([("norm", p, n) for p, n in rules.MOVEMENTS], "norm"))
_over_documents("availability_of_texts", text.availability, f"CASE WHEN regexp_matches(lower(text), '{rules.GONE}') THEN false WHEN regexp_matches(lower(text), '{rules.THERE}') THEN true END", "BOOLEAN")
_over_documents("category_of_texts", text.category_of, "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keywords) + f" THEN '{n}'" for n, (keywords, *_) in rules.CATEGORIES.items() if keywords) + " ELSE 'default' END", "VARCHAR")


@query(f"""SELECT id, {r2("id * 7 + (id % 100) / 100.0")} AS price, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 90 + 10 AS VARCHAR) || CASE WHEN id % 3 = 1 THEN '.5' ELSE '' END END AS size, CAST(id % 20 AS VARCHAR) AS carats, id % 2 = 0 AS damaged,
  CASE WHEN id % 4 >= id % 5 AND id % 4 >= id % 3 THEN ',' WHEN id % 5 >= id % 3 THEN chr(9) ELSE ';' END AS mark FROM products""")
def parsed_numbers(s, d):
    """Prices, sizes, carats, damaged identifiers and delimiters made of each product's number."""
    i = F.col("id")
    price = F.concat(F.lit("now £"), F.format_number(i * 7, 0), F.lit("."), F.lpad((i % 100).cast("string"), 2, "0"))
    size = F.concat((i % 90 + 10).cast("string"), F.when(i % 3 == 1, ".5 mm").when(i % 3 == 2, "mm").otherwise(" cm"))
    header = F.concat(F.lit("a"), F.repeat(F.lit(",b"), (i % 4).cast("int")), F.repeat(F.lit("\tc"), (i % 5).cast("int")), F.repeat(F.lit(";d"), (i % 3).cast("int")))
    damaged = F.concat(F.lit("7.32"), F.when(i % 2 == 0, "E+").otherwise("-"), (i % 12).cast("string"))
    return v.products(s, d).select("id", money.parse_price(price).alias("price"), text.case_size(size).alias("size"), text.carat(F.concat((i % 20).cast("string"), F.lit(" ct"))).alias("carats"), text.damaged_identifier(damaged).alias("damaged"), text.detect_delimiter(header).alias("mark"))


_AGO = "date_diff('second', started_at, TIMESTAMP '2026-08-09 12:00:00')"


@query(f"""SELECT id, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, CAST(floor(floor(floor({_AGO} / 60.0 + 0.5) / 60 + 0.5) / 24 + 0.5) AS BIGINT) || 'd ago' AS ago,
  CAST({_AGO} * 1000 AS BIGINT) AS lasted_ms, CASE WHEN id % 101 >= 85 THEN 'high' WHEN id % 101 >= 55 THEN 'mid' ELSE 'low' END AS tone FROM runs""")
def time_texts(s, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    return v.runs(s, d).select("id", labels.iso_text(F.col("started_at")).alias("iso"), labels.relative_time(F.col("started_at"), now).alias("ago"), labels.duration_ms(F.col("started_at"), now).alias("lasted_ms"), labels.confidence_tone(F.col("id") % 101).alias("tone"))


@query("""SELECT id, concat_ws(' · ', CASE WHEN p_size % 2 = 0 THEN p_size || 'mm' END, ean_mpn) AS detail, 'x.co' AS host, brand || ' ' || CASE WHEN id % 4 = 0 THEN 'R-' || id ELSE product_name END AS term,
  CASE WHEN id % 3 = 0 THEN id || ' (' || id % 3 + id % 5 || ' without)' ELSE id || ' — complete' END AS priced FROM products WHERE id % 3 + id % 5 > 0 AND (id % 3 = 0 OR id % 5 = 0)""")
def product_texts(s, d):
    i = F.col("id")
    specs = F.create_map(F.lit("case_size"), F.when(F.col("specs")["size"].cast("int") % 2 == 0, F.concat(F.col("specs")["size"], F.lit("mm"))), F.lit("Ref"), F.when(i % 4 == 0, F.concat(F.lit(" R-"), i.cast("string"))))
    rows = v.products(s, d).where((i % 3 + i % 5 > 0) & ((i % 3 == 0) | (i % 5 == 0))).withColumn("specs", specs)
    missing = F.when(i % 3 == 0, i % 3 + i % 5).otherwise(0)
    return rows.select("id", labels.product_detail(F.col("specs"), F.col("ean_mpn")).alias("detail"), labels.host_of(F.lit("https://u@X.co?a")).alias("host"), text.search_term(F.col("brand"), F.col("product_name"), F.col("specs")).alias("term"), labels.completeness(i, missing).alias("priced"))


@query("""SELECT id, CASE WHEN total > 0 THEN 'Usable' WHEN error = 'robots.txt is out of reach' THEN 'Blocked at robots.txt' WHEN error IS NOT NULL THEN 'No route' WHEN indexes > 0 THEN 'Index only' WHEN failed > 0 THEN 'Sitemap unreadable'
  WHEN declared = 0 THEN 'None published' ELSE 'Empty' END AS verdict FROM (
  SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 3 END AS total, CASE id % 7 WHEN 0 THEN 'robots.txt is out of reach' WHEN 1 THEN 'no address' END AS error, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS indexes, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS failed, id % 4 AS declared FROM products)""")
def sitemap_verdicts(s, d):
    i = F.col("id")
    total, error = F.when(i % 2 == 0, 0).otherwise(i % 3), F.when(i % 7 == 0, "robots.txt is out of reach").when(i % 7 == 1, "no address")
    return v.products(s, d).select("id", pages.sitemap_verdict(error, total, F.when(i % 5 == 0, 1).otherwise(0), F.when(i % 3 == 0, 2).otherwise(0), i % 4).alias("verdict"))


@query("SELECT competitor_id, url, slug, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2026-01-02 00:00:00' END AS lastmod FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM (SELECT id % 9 AS competitor_id, 'https://x.co/p/' || id % 500 || '/' || id % 9 AS url, 'p ' || id % 500 || ' ' || id % 9 AS slug, id FROM products)) WHERE rn = 1")
def sitemap_harvest(s, d):
    """Addresses that several files tell: the first file's entry counts."""
    i = F.col("id").cast("string")
    own = v.products(s, d).withColumn("competitor_id", F.col("id") % 9)
    body = F.concat(F.lit("<url><loc>https://x.co/p/"), (F.col("id") % 500).cast("string"), F.lit("/"), F.col("competitor_id").cast("string"), F.lit("</loc>"), F.when(F.col("id") % 2 == 0, "<lastmod>2026-01-02</lastmod>").otherwise("<lastmod>soon</lastmod>"), F.lit("</url>"))
    files = own.select("competitor_id", F.col("id").alias("turn"), i.alias("file"), body.alias("body"))
    return pages.harvest(pages.sitemap_entries(files)).withColumn("lastmod", F.col("lastmod").cast("timestamp_ntz"))


@query("""SELECT id AS site, 'https://x.co/p' || id || '?q=1' AS url, CASE WHEN id % 6 = 0 THEN true WHEN id % 6 = 1 THEN false WHEN '/p' || id LIKE '/p12%' THEN true WHEN '/p' || id LIKE '%9' THEN false WHEN '/p' || id LIKE '/p1%' THEN false ELSE true END AS allowed,
  CASE id % 6 WHEN 0 THEN 'absent' WHEN 1 THEN 'unreachable' ELSE 'ok' END AS state FROM products""")
def robots_inspection(s, d):
    i = F.col("id")
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: PriceMonitorBot\nUser-agent: x\nDisallow: /p1\nAllow: /p12*\nDisallow: /*9?q\nDisallow: /p$\n")
    own = v.products(s, d).select(i.alias("site"), F.when(i % 6 == 0, 404).when(i % 6 == 1, 503).otherwise(200).alias("status"), body.alias("body"), F.concat(F.lit("https://x.co/p"), i.cast("string"), F.lit("?q=1")).alias("url"))
    return pages.inspect_robots(own.select("site", "status", "body"), own.select("site", "url"), "PriceMonitorBot/0.1").select("site", "url", "allowed", "state")


@query("SELECT slug, CASE WHEN slug = 'shop-3' THEN NOT enabled ELSE enabled END AS enabled FROM competitors")
def competitor_toggle(s, d):
    own = v.competitors(s, d)
    was = own.where("slug = 'shop-3'").first()
    return mutations.set_enabled(own, "shop-3", not was.enabled).select("slug", "enabled")


@query("SELECT product_id, competitor_id, url, tier, status FROM matches UNION ALL SELECT 1, 1, 'https://x.co/new', 'manual', 'pending'")
def match_manual(s, d):
    old = v.matches(s, d).drop("id", "confirmed_at")
    return mutations.add_manual_match(old, 1, 1, "https://x.co/new", "https://x.co").select("product_id", "competitor_id", "url", "tier", "status")


@query("SELECT id AS run_id, status, started_at, CASE WHEN status != 'running' THEN started_at + INTERVAL 1 HOUR END AS finished_at FROM runs")
def run_lifecycle(s, d):
    own = v.runs(s, d).select(F.col("id").alias("run_id"), "status", "started_at")
    ended = own.where("status != 'running'").select("run_id", F.col("status").alias("event"), (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return mutations.run_states(own.select("run_id", F.lit("started").alias("event"), F.col("started_at").alias("at")).union(ended))


@query("SELECT id, 'https://x.co/s?q=' || url_encode(brand || ' ' || product_name) AS url FROM products")
def search_urls(s, d):
    return v.products(s, d).select("id", shops.search_url(F.lit("https://x.co/s?q={query}"), F.concat_ws(" ", "brand", "product_name")).alias("url"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'the brand of the listing is not known to be ours' WHEN 1 THEN 'the listing''s EAN/MPN differs from ours' WHEN 2 THEN 'its metal type does not agree with ours'
  ELSE 'its confidence of ' || id % 25 || '% is below the 25% needed' END AS reason FROM products""")
def rejection_reasons(s, d):
    gates = F.get(F.array(*[F.array(F.lit(g)) for g in ("brand", "ean_mpn", "metal_type")], F.array().cast("array<string>")), (F.col("id") % 4).cast("int"))
    return v.products(s, d).select("id", matching.rejection_reason((F.col("id") % 25).cast("int"), gates).alias("reason"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN CAST(id % 90 + 10 AS VARCHAR) WHEN 1 THEN 'm' || id WHEN 2 THEN 'a and b ' || id WHEN 3 THEN NULL ELSE '18ct rose gold' END AS value FROM products""")
def normalise_attribute(s, d):
    i = F.col("id")
    names = F.get(F.array(*[F.lit(x) for x in ("case_size", "reference_number", "model", "collection", "metal_type")]), (i % 5).cast("int"))
    n = i.cast("string")
    value = F.when(i % 5 == 0, F.concat((i % 90 + 10).cast("string"), F.lit(" mm"))).when(i % 5 == 1, F.concat(F.lit("M-"), n)).when(i % 5 == 2, F.concat(F.lit(" A & B  "), n)).when(i % 5 == 3, "  ").otherwise("18 carat Red Gold")
    return v.products(s, d).select("id", text.normalise_attribute(names, value).alias("value"))


_HASHED = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (h * 31 + c) % {1})"


@query(f"""SELECT p.id, list_extract([{", ".join(map(str, rules.BRAND_HUES))}], CAST({_HASHED.format("brand", 2**32)} % {len(rules.BRAND_HUES)} AS INTEGER) + 1) AS brand_hue,
  CAST({_HASHED.format("internal_sku", 100_000)} % 141 + 190 AS INTEGER) AS hue FROM products p""")
def hues(s, d):
    return v.products(s, d).select("id", labels.brand_hue(F.col("brand")).alias("brand_hue"), text.hue(F.col("internal_sku")).cast("int").alias("hue"))


@query("""SELECT id, CASE WHEN id % 6 = 0 THEN '—' ELSE CASE WHEN id % 2 = 0 THEN '-' ELSE '' END || '£' || format('{:,}', id * 997) || '.25' END AS money, CASE WHEN id % 6 = 0 THEN '—' WHEN id % 2 = 0 THEN '-' || id % 50 || '.5%' ELSE '+' || id % 50 || '.5%' END AS share FROM products""")
def money_texts(s, d):
    i = F.col("id")
    side = F.when(i % 6 == 0, F.lit(None)).when(i % 2 == 0, -1.0).otherwise(1.0)
    return v.products(s, d).select("id", labels.money_text(side * (i * 997 + 0.25), F.lit("GBP")).alias("money"), labels.percent_text(side * (i % 50 + 0.5)).alias("share"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'legacy-xls' WHEN 2 THEN 'html' ELSE 'text' END AS format, CASE id % 5 WHEN 3 THEN 'image/png' WHEN 4 THEN 'image/svg+xml' END AS image FROM products""")
def content_kinds(s, d):
    heads = [F.unhex(F.lit(x)) for x in ("504B0304", "D0CF11E0A1B11AE1", "20203C68746D6C3E", "89504E470D0A", "3C7376673E")]
    content = F.concat(F.get(F.array(*heads), (F.col("id") % 5).cast("int")), F.col("product_name").cast("binary"))
    return v.products(s, d).select("id", text.detect_format(content).alias("format"), text.image_type(content).alias("image"))


# Pages.
def _generated(s, d) -> DataFrame:
    """A product page for each product; to read one costs much more than its row's share of the file lets Spark expect."""
    html = F.format_string(
        '<html><head><link rel="icon" sizes="32x32" href="/i.png"><script type="application/ld+json">{"@type":"Product","name":"%s","gtin13":"%s","offers":{"@type":"Offer","price":"%.2f","priceCurrency":"GBP","availability":"InStock"}}</script></head>'
        '<body><h1>x</h1><div class="tile"><a href="/p/%d" title="t">%s</a><span class="cost">£9.50</span></div><table><tr><th>Case Size</th><td>%dmm</td></tr></table></body></html>',
        "product_name", F.coalesce("ean_mpn", F.lit("")), F.col("id") + 0.5, "id", "product_name", F.col("id") % 40 + 20,
    )
    return dealt_out(v.products(s, d), "id").select("id", F.lit("https://x.co/p").alias("url"), html.alias("html"))


@query("""SELECT id, product_name AS title, CAST(id + 0.5 AS DOUBLE) AS price, CASE WHEN id + 0.5 > 5000000 THEN 'implausible_price' END AS error_kind, true AS in_stock, ean_mpn AS ean, (id % 40 + 20) || 'mm' AS case_size, 'json-ld' AS source FROM products""")
def extract_listing(s, d):
    rows = pages.extract_listings(_generated(s, d), {})
    got = lambda c: F.col(f"listing.{c}").alias(c)
    return rows.select("id", got("title"), got("price"), got("error_kind"), got("in_stock"), got("ean"), F.try_element_at("listing.attributes", F.lit("case_size")).alias("case_size"), got("source"))


@query("SELECT id, product_name AS title, 'GBP' AS currency, 'InStock' AS availability, ean_mpn AS ean, false AS promo FROM products")
def jsonld_product(s, d):
    rows = pages.extract_listings(_generated(s, d).drop("url"), {"selectors": {"title": [".none"]}})
    return rows.select("id", *[F.col(f"listing.{c}").alias(c) for c in ("title", "currency", "availability", "ean", "promo")])


def _with_head(s, d) -> DataFrame:
    """Every page with linked data, icons and a table of its own put into it, beside all that it holds."""
    i = F.col("page_id")
    head = F.format_string(
        '<!-- <script type="application/ld+json">{"@type":"Product","name":"no"}</script> --><script type=\'application/ld+json\'>{"@graph":[{"@type":"WebPage"},{"offers":[[{"@type":["https://schema.org/Offer"],"price":%d.50,"priceCurrency":"EUR"}]],'
        '"@type":"https://schema.org/Product","name":{"@value":"Page %d"},"mpn":%d,"additionalProperty":[{"name":"Strap","value":"a"},{"name":"strap","value":"b%d"}]}]}</script>'
        '<link rel="icon" sizes="16x16" href="a/../i%d.png"><link href=\'?v=%d\' rel=\'ICON\' sizes=\'32x32\'><link rel="mask-icon" href="mailto:x"></head>',
        i, i, i, i, i, i,
    )
    rows = F.format_string("<table><tr><th>Case&#32;Size</th><td>%d&nbsp;mm<tr><td colspan=2>x<tr><td>Strap<td>c</table><footer>", i)
    html = F.replace(F.replace("html", F.lit("</head>"), head), F.lit("<footer>"), rows)
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", html.alias("html"))


@query("SELECT page_id, 'Page ' || page_id AS title, page_id + 0.5::DOUBLE AS price, 'EUR' AS currency, CAST(page_id AS VARCHAR) AS ean, 'b' || page_id AS strap, page_id || ' mm' AS case_size, 'json-ld' AS source FROM pages")
def page_listings(s, d):
    """Listings of all pages from linked data amid lists, addresses of kinds and numbers, and from tables left open."""
    rows = pages.extract_listings(_with_head(s, d), {})
    of = lambda key: F.try_element_at("listing.attributes", F.lit(key))
    return rows.select("page_id", *[F.col(f"listing.{c}").alias(c) for c in ("title", "price", "currency", "ean")], of("strap_material").alias("strap"), of("case_size").alias("case_size"), F.col("listing.source").alias("source"))


@query(r"""SELECT page_id, concat_ws(' ', regexp_extract(url, '^https?://[^/?#]+[^?#]*') || '?v=' || page_id, regexp_extract(url, '^https?://[^/?#]+[^?#]*/') || 'i' || page_id || '.png', regexp_extract(url, '^https?://[^/?#]+') || '/favicon.ico') AS icons FROM pages""")
def page_icons(s, d):
    """The icons of all pages, addresses resolved against each page's own."""
    return pages.icon_urls(_with_head(s, d)).select("page_id", F.array_join("icons", " ").alias("icons"))


@query("SELECT id, CAST(0 AS BIGINT) AS place, 'https://x.co/p/' || id AS url, 't' AS title, CAST(9.5 AS DOUBLE) AS price FROM products")
def extract_search(s, d):
    found = pages.search_results(_generated(s, d), {"resultItem": [".tile"], "resultPrice": [".cost"]}, "https://x.co")
    return found.withColumn("place", F.col("place").cast("long"))


@query("SELECT id, 'https://x.co/i.png,https://x.co/favicon.ico' AS icons FROM products")
def icon_urls(s, d):
    return pages.icon_urls(_generated(s, d)).select("id", F.array_join("icons", ",").alias("icons"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '') AS title, 'no_price_found' AS error_kind FROM pages""")
def page_titles(s, d):
    found = pages.extract_listings(s.read.parquet(f"{d}/pages.parquet").drop("url"), {})
    return found.select("page_id", F.col("listing.title").alias("title"), F.col("listing.error_kind").alias("error_kind"))


@query("SELECT id, 'https://x.co/p/' || id || '?a=1&b=2' AS loc, CASE WHEN id % 2 = 0 THEN '2026-01-02' END AS lastmod FROM products")
def sitemap_urls(s, d):
    body = F.concat(F.lit("<urlset><url><loc> https://x.co/p/"), F.col("id").cast("string"), F.lit("?a=1&amp;b=2 </loc>"), F.when(F.col("id") % 2 == 0, "<lastmod>2026-01-02</lastmod>").otherwise(""), F.lit("</url></urlset>"))
    return pages.sitemap_entries(v.products(s, d).select("id", body.alias("body"))).select("id", "loc", "lastmod")


@query("SELECT id AS site, '/p' || id AS rule, CAST(1 AS BIGINT) AS place FROM products UNION ALL SELECT id, '/all', CAST(5 AS BIGINT) FROM products")
def robots_rules(s, d):
    body = F.concat(F.lit("User-agent: PriceMonitorBot\nDisallow: /p"), F.col("id").cast("string"), F.lit(" # no\nUser-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /all\nDisallow:"))
    return pages.robots_rules(v.products(s, d).select(F.col("id").alias("site"), body.alias("body")), "PriceMonitorBot/0.1").withColumn("place", F.col("place").cast("long"))


@query("""SELECT count(*) FILTER (id % 6 = 0 OR (id % 6 > 1 AND ok)) AS search_allowed, count(*) FILTER (id % 6 = 1 OR (id % 6 > 1 AND NOT ok)) AS search_blocked, count(*) FILTER (id % 6 = 1) AS unreachable FROM (
  SELECT id, '/p' || id LIKE '/p12%' OR ('/p' || id NOT LIKE '%9' AND '/p' || id NOT LIKE '/p1%') AS ok FROM products)""")
def robots_summary(s, d):
    return pages.robots_summary(robots_inspection(s, d))


@query(r"""SELECT page_id, coalesce(NOT allow, false) AS disallowed FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages)
  LEFT JOIN (
    SELECT p.page_id, max_by(r.allow, length(r.rule) * 2 + CAST(r.allow AS INTEGER)) AS allow
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages) p
    JOIN (SELECT DISTINCT site, page_id % 2 = 0 AS allow, page_id % 3 AS kind, CASE page_id % 3 WHEN 0 THEN substr(path, 1, 12) WHEN 1 THEN '/*' || right(path, 2) || '$' ELSE substr(path, 1, 2) || '*' || right(path, 3) END AS rule, path AS of
          FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages) WHERE length(path) >= 4 AND page_id % 50 < 5) r ON r.site = p.site
      AND CASE kind WHEN 0 THEN starts_with(p.path, r.rule) WHEN 1 THEN starts_with(p.path, '/') AND ends_with(p.path, right(of, 2)) AND length(p.path) >= 3 ELSE starts_with(p.path, substr(of, 1, 2)) AND contains(substr(p.path, 3), right(of, 3)) END
    GROUP BY p.page_id) USING (page_id)""")
def robots_of_pages(s, d):
    """Every page's address against its site's robots rules, which are made of the site's own paths: beginnings, endings, both."""
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("site"))
    path, kind = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^#]*)", 1), F.col("page_id") % 3
    rule = F.when(kind == 0, F.substring("path", 1, 12)).when(kind == 1, F.concat(F.lit("/*"), F.expr("right(path, 2)"), F.lit("$"))).otherwise(F.concat(F.substring("path", 1, 2), F.lit("*"), F.expr("right(path, 3)")))
    groups = rows.withColumn("path", path).where((F.length("path") >= 4) & (F.col("page_id") % 50 < 5)).select("site", (F.col("page_id") % 2 == 0).alias("allow"), rule.alias("rule"))
    return pages.robots_probe(rows, groups).select("page_id", "disallowed")


# Versions: a chain of changes, each committed on top of the one before it; every version is read as it was.
_CHAIN = _FEED + """, fed AS (SELECT f.*, p.id, p.source FROM parsed f LEFT JOIN products p ON p.internal_sku = f.sku WHERE kind IN ('hidden', 'priced')),
paid AS (SELECT * FROM fed WHERE kind = 'priced'),
prices2 AS (
  SELECT product_id, feed_import_id FROM fascia_prices f JOIN products p ON p.id = f.product_id WHERE (fascia_id != 1 OR source = 'manual') AND NOT (fascia_id = 1 AND product_id IN (SELECT id FROM paid WHERE id IS NOT NULL))
  UNION ALL SELECT id, CAST(3 AS BIGINT) FROM paid),
products2 AS (
  SELECT id, CASE WHEN id IN (SELECT product_id FROM prices2 WHERE product_id IS NOT NULL) THEN true WHEN source = 'manual' THEN delisted_at IS NULL ELSE false END AS live FROM products
  UNION ALL SELECT NULL, kind = 'priced' FROM fed WHERE id IS NULL),
scored AS (
  SELECT product_id, competitor_id, url, (product_id + competitor_id) % 101 AS confidence FROM matches WHERE (product_id + competitor_id) % 4 = 0
  UNION ALL SELECT product_id, competitor_id, url || '/new', (product_id + competitor_id) * 3 % 101 FROM matches WHERE (product_id + competitor_id) % 7 = 0),
judged AS (
  SELECT product_id, competitor_id, url, m.id, m.status, s.confidence, coalesce(m.confirmed_by != 'auto', false) OR coalesce(m.status = 'rejected', false) AS decided FROM matches m FULL JOIN scored s USING (product_id, competitor_id, url)),
turns AS (
  SELECT j.*, coalesce(confidence >= 85, false) AND NOT decided AS asks, row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY coalesce(confidence >= 85, false) AND NOT decided DESC, confidence DESC NULLS LAST, url) AS turn,
         max(CASE WHEN status = 'confirmed' THEN url END) OVER (PARTITION BY product_id, competitor_id) AS held FROM judged j),
matches3 AS (
  SELECT product_id, competitor_id, url, id, CASE WHEN status IS NOT NULL AND (decided OR confidence IS NULL) THEN status WHEN NOT asks THEN 'pending'
         WHEN held IS NOT NULL THEN CASE WHEN url = held THEN 'confirmed' ELSE 'pending' END WHEN turn = 1 THEN 'confirmed' ELSE 'pending' END AS status FROM turns),
chosen AS (SELECT product_id, competitor_id, id FROM matches3 WHERE status = 'pending' AND id IS NOT NULL ORDER BY id LIMIT 1),
matches4 AS (
  SELECT m.product_id, CASE WHEN m.id = c.id THEN 'confirmed' WHEN c.id IS NOT NULL AND m.status = 'confirmed' THEN 'rejected' ELSE m.status END AS status
  FROM matches3 m LEFT JOIN chosen c ON c.product_id = m.product_id AND c.competitor_id = m.competitor_id)
SELECT CAST(version AS BIGINT) AS version, "table", n, CAST(marked AS BIGINT) AS marked FROM (
  SELECT 1 AS version, 'products' AS "table", count(*) AS n, count(*) FILTER (delisted_at IS NULL) AS marked FROM products
  UNION ALL SELECT 1, 'prices', count(*), count(*) FILTER (feed_import_id = 3) FROM fascia_prices
  UNION ALL SELECT 1, 'matches', count(*), count(*) FILTER (status = 'confirmed') FROM matches
  UNION ALL SELECT 1, 'competitors', count(*), count(*) FILTER (enabled) FROM competitors
  UNION ALL SELECT 2, 'products', count(*), count(*) FILTER (live) FROM products2
  UNION ALL SELECT 2, 'prices', count(*), count(*) FILTER (feed_import_id = 3) FROM prices2
  UNION ALL SELECT 2, 'imports', 1, count(*) FROM paid
  UNION ALL SELECT 3, 'matches', count(*), count(*) FILTER (status = 'confirmed') FROM matches3
  UNION ALL SELECT 4, 'matches', count(*), count(*) FILTER (status = 'confirmed') FROM matches4
  UNION ALL SELECT 5, 'competitors', count(*) + 1, count(*) FILTER (enabled) + 1 FROM competitors
  UNION ALL SELECT 6, 'products', count(*) FILTER (id % 10 = 0 IS NOT TRUE), count(*) FILTER (live AND id % 10 = 0 IS NOT TRUE) FROM products2
  UNION ALL SELECT 6, 'prices', count(*) FILTER (product_id % 10 = 0 IS NOT TRUE), count(*) FILTER (feed_import_id = 3 AND product_id % 10 = 0 IS NOT TRUE) FROM prices2
  UNION ALL SELECT 6, 'matches', count(*) FILTER (product_id % 10 != 0), count(*) FILTER (status = 'confirmed' AND product_id % 10 != 0) FROM matches4)"""


@query(_CHAIN)
def state_chain(s, d):
    """Import, scores, a confirmation, a sync and a deletion, each a commit; the rows of every table that a version changed, read back from it."""
    log, now = SnapshotLog(s, workspace(s, "chain")), _now().cast("timestamp_ntz")
    log.commit("start", {"products": v.products(s, d), "prices": v.fascia_prices(s, d), "matches": v.matches(s, d), "competitors": v.competitors(s, d)})
    parsed: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept, path = log.staged(df)
        parsed.append(path)
        return kept

    out = feed.run_import(log.tables(1), dealt_out(v.feed_rows(s, d), "row_number"), SITE, 3, now, keep=keep)
    log.commit("import", {k: out[k] for k in ("products", "prices", "imports")}, base=1)
    log.store.delete(parsed[0])
    n = F.col("product_id") + F.col("competitor_id")
    known = log.read("matches", 2).select("product_id", "competitor_id", "url", n.alias("n"))
    run = known.where("n % 4 = 0").withColumn("confidence", (F.col("n") % 101).cast("int"))
    run = run.union(known.where("n % 7 = 0").select("product_id", "competitor_id", F.concat("url", F.lit("/new")), "n", (F.col("n") * 3 % 101).cast("int")))
    run = run.withColumns({"tier": F.lit("fuzzy_name_specs"), "status": F.when(F.col("confidence") >= rules.AUTO_ACCEPT, "confirmed").otherwise("pending")})
    log.commit("score", {"matches": mutations.upsert_matches(log.read("matches", 2), run, now)}, base=2)
    first = log.read("matches", 3).where("status = 'pending'").agg(F.min("id")).first()[0]
    log.commit("confirm", {"matches": mutations.confirm_match(log.read("matches", 3), first, "kim", now)}, base=3)
    shops_now = log.read("competitors", 4)
    files = shops_now.where("id % 2 = 0").withColumns({"display_name": F.upper("display_name"), "enabled": F.lit(True)})
    files = files.union(shops_now.limit(1).withColumns({"slug": F.lit("shop-new"), "enabled": F.lit(True)}))
    log.commit("sync", {"competitors": mutations.sync_competitors(shops_now, files.drop("id"))}, base=4)
    tables = {k: log.read(k, 5) for k in ("products", "prices", "matches")}
    log.commit("delete", mutations.delete_products(tables, tables["products"].where("internal_sku LIKE '%0'")), base=5)
    marks = {"products": "delisted_at IS NULL", "prices": "feed_import_id = 3", "matches": "status = 'confirmed'", "competitors": "enabled", "imports": "true"}
    each = []
    for version in range(1, log.version() + 1):
        for t in log.manifest(version)["changed"]:
            marked = F.sum("prices_written") if t == "imports" else F.count_if(F.expr(marks[t]))
            each.append(log.read(t, version).agg(F.count("*").alias("n"), marked.alias("marked")).select(F.lit(version).cast("long").alias("version"), F.lit(t).alias("table"), "n", "marked"))
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out


_RECOUNTED = _KEPT + """, listed AS (SELECT source, CASE WHEN id IN (SELECT product_id FROM kept) THEN NULL WHEN source = 'manual' THEN delisted_at ELSE coalesce(delisted_at, TIMESTAMP '2026-08-09 12:00:00') END AS delisted_at FROM products),
decided AS (SELECT product_id, CASE WHEN competitor_id = 3 THEN 'rejected' WHEN competitor_id = 5 AND status = 'pending' THEN 'confirmed' ELSE status END AS status FROM matches)
"""


def _kept_after_import(s, d):
    """Bitmaps of the tables as they were, then brought up to date by what an import and two decisions about shops changed."""
    log = SnapshotLog(s, workspace(s, "kept-counts"))
    products, prices, matches = v.products(s, d), v.fascia_prices(s, d), v.matches(s, d)
    log.commit("number", {"numbers": kept_counts.number_keys(products.select("id"))})
    numbers = log.read("numbers")
    log.commit("count", {"kept": kept_counts.keep(kept_counts.members(products, prices, matches), numbers)})
    after, site = _kept(s, d), F.col("fascia_id") == SITE
    listed = feed.relist(products, after, _now().cast("timestamp_ntz"))
    touched = matches.where("competitor_id IN (3, 5)")
    status = F.when(F.col("competitor_id") == 3, "rejected").when(F.col("status") == "pending", "confirmed").otherwise(F.col("status"))
    was = kept_counts.members(products, prices.where(site), touched)
    now = kept_counts.members(listed, after.where(site), touched.withColumn("status", status))
    changes = kept_counts.membership_changes(was, now)
    log.commit("import", {"kept": kept_counts.bring_up_to_date(log.read("kept"), changes, numbers)})
    return log.read("kept")


@query(_RECOUNTED + """SELECT count(*) FILTER (delisted_at IS NULL) AS products, count(*) FILTER (delisted_at IS NOT NULL) AS delisted, count(*) FILTER (delisted_at IS NULL AND source = 'manual') AS manual,
  (SELECT count(DISTINCT product_id) FROM kept) AS with_price, (SELECT count(DISTINCT product_id) FROM decided WHERE status = 'confirmed') AS products_matched,
  count(*) FILTER (delisted_at IS NULL) - (SELECT count(DISTINCT product_id) FROM kept) AS awaiting_price FROM listed""")
def status_kept(s, d):
    """The status after an import, from kept bitmaps and the changes alone; the SQL counts again."""
    return kept_counts.kept_status(_kept_after_import(s, d))


@query(_RECOUNTED + "SELECT code, name, count(k.product_id) AS priced, (SELECT count(*) FROM listed WHERE delisted_at IS NULL) - count(k.product_id) AS missing FROM fascias LEFT JOIN kept k ON k.fascia_id = fascias.id GROUP BY code, name")
def coverage_kept(s, d):
    """Each site's coverage after an import, from kept bitmaps and the changes alone."""
    return kept_counts.kept_coverage(_kept_after_import(s, d), v.fascias(s, d))


def _in_three_parts(s, df: DataFrame, key: str, through: Callable[[DataFrame], object]) -> None:
    """A table's rows arrive in three parts; after each a stream takes in what is new."""
    path = workspace(s, "arriving")
    for k in range(3):
        df.where(F.pmod(F.xxhash64(key), F.lit(3)) == k).write.mode("append").parquet(path)
        through(s.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query("SELECT run_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped FROM items GROUP BY run_id")
def run_counters_live(s, d):
    """Counters kept up by a stream of run items, each batch taken once."""
    log, place = SnapshotLog(s, workspace(s, "counters")), workspace(s, "counters-stream")
    _in_three_parts(s, v.items(s, d).select("id", "run_id", "status"), "id", lambda items: live.live_counters(items, log, "counters", place))
    return log.read("counters").select("run_id", "ok", "error", "skipped")


@query("SELECT product_id, competitor_id, run_id, line, price, in_stock, observed_at FROM latest")
def latest_live(s, d):
    """The last observation of every pair, kept up by a stream whose rows arrive in any order."""
    log, place = SnapshotLog(s, workspace(s, "latest")), workspace(s, "latest-stream")
    rows = v.observations(s, d).select("product_id", "competitor_id", "run_id", "line", "price", "in_stock", "observed_at")
    _in_three_parts(s, rows, "run_id", lambda new: live.live_latest(new, log, "latest", place, F.struct("observed_at", "run_id", "line")))
    return log.read("latest")


@query("""SELECT competitor_id, file, row_number() OVER (PARTITION BY competitor_id ORDER BY level, file) AS turn FROM (
  SELECT competitor_id, file, min(level) AS level FROM (
    WITH RECURSIVE links AS (
      SELECT CAST(r_regionkey AS BIGINT) AS competitor_id, p_partkey AS k, unnest([p_partkey * (r_regionkey + 2), p_partkey * (r_regionkey + 2) + 1, 1]) AS child FROM part, region WHERE p_partkey > 0),
    walk AS (
      SELECT CAST(r_regionkey AS BIGINT) AS competitor_id, CAST(1 AS BIGINT) AS k, 0 AS level FROM region
      UNION SELECT w.competitor_id, l.child, level + 1 FROM walk w JOIN links l ON l.competitor_id = w.competitor_id AND l.k = w.k WHERE level < 18 AND l.child != 1)
    SELECT competitor_id, 'https://x.co/m' || k || '.xml' AS file, level FROM walk) GROUP BY competitor_id, file) QUALIFY turn <= 100""")
def sitemap_walk(s, d):
    """Sitemap files that list others, two each and the first one again, for five shops."""
    part, region = dealt_out(s.read.parquet(f"{d}/part.parquet"), "p_partkey"), F.broadcast(s.read.parquet(f"{d}/region.parquet"))  # region has five rows
    both = part.where("p_partkey > 0").crossJoin(region).select(F.col("r_regionkey").cast("long").alias("competitor_id"), F.col("p_partkey").alias("k"), (F.col("r_regionkey") + 2).alias("step"))
    tag = lambda k: F.concat(F.lit("<sitemap><loc>https://x.co/m"), k.cast("string"), F.lit(".xml</loc></sitemap>"))
    body = F.concat(F.lit("<sitemapindex>"), *[tag(k) for k in (F.col("k") * F.col("step"), F.col("k") * F.col("step") + 1, F.lit(1))], F.lit("</sitemapindex>"))
    files = both.select("competitor_id", F.format_string("https://x.co/m%d.xml", "k").alias("file"), body.alias("body"))
    roots = files.where(F.col("file") == "https://x.co/m1.xml").select("competitor_id", "file")
    return pages.walked(pages.sitemap_entries(files), roots).withColumn("turn", F.col("turn").cast("long"))


@query(_FEED + """SELECT CAST(row_number AS BIGINT) AS "row", sku AS id, CASE kind WHEN 'untitled' THEN 'title is missing' ELSE 'price "' || CASE WHEN row_number % 13 = 0 THEN 'on request' END || '" could not be read' END AS error
  FROM parsed WHERE kind = 'untitled' OR (row_number % 13 = 0 AND kind = 'priced') ORDER BY row_number LIMIT 200""")
def feed_errors(s, d):
    rows = v.feed_rows(s, d)
    return feed.import_errors(rows.withColumn("price", F.when(F.col("row_number") % 13 == 0, " on request ").otherwise(F.col("price"))))


@query("""SELECT id, CAST(CASE WHEN id % 7 = 0 THEN 500 ELSE 2000 END * 2 ** (id % 5) AS BIGINT) AS wait_ms, id % 5 < 3 AND id % 3 != 0 AS again FROM items""")
def retry_delays(s, d):
    attempt, kind = F.col("id") % 5 + 1, F.when(F.col("id") % 3 == 0, "blocked").when(F.col("id") % 3 == 1, "timeout")
    wait = text.retry_delay(attempt, F.when(F.col("id") % 7 == 0, 500))
    return v.items(s, d).select("id", wait.alias("wait_ms"), text.retried(attempt, F.lit(4), kind).alias("again"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/avif' ELSE 'image/x-icon' END AS content_type, id % 4 < 2 AND id % 6 != 5 AS kept FROM products""")
def logo_types(s, d):
    i = F.col("id")
    content = F.when(i % 6 == 5, F.lit("")).when(i % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A00000000"))).otherwise(F.lit("some bytes").cast("binary"))
    content = F.when((i % 6 == 5) & (i % 4 != 0), F.lit("").cast("binary")).otherwise(content)
    declared = F.when(i % 4 == 1, "Image/AVIF; q=1").when(i % 4 == 2, "text/html")
    return v.products(s, d).select("id", text.content_type_of(declared, content).alias("content_type"), text.renderable_image(declared, content).alias("kept"))


@query("SELECT id, status, competitor_id, product_id, CAST(NULL AS VARCHAR) AS mode FROM runs UNION ALL SELECT (SELECT max(id) + 1 FROM runs), 'running', 3, NULL, 'both'")
def run_started(s, d):
    return mutations.start_run(v.runs(s, d), "both", _now().cast("timestamp_ntz"), competitor_id=3).select("id", "status", "competitor_id", "product_id", "mode")


@query("SELECT product_id, competitor_id, run_id, line, price FROM observations ORDER BY price DESC, run_id, line LIMIT 100 OFFSET 40000")
def observation_page_deep(s, d):
    """A page far down the observations by price: only the ranges of prices that hold it are sorted."""
    rows = v.observations(s, d).select("product_id", "competitor_id", "run_id", "line", "price")
    return cmp.page(rows, [F.desc("price"), F.asc("run_id"), F.asc("line")], 100, 40_000)

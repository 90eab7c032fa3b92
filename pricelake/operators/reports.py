"""Status, review queue, runs and their items, worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.operators.comparison import asked
from pricelake.sources.shared import many_tasks


def review_queue(matches: DataFrame, products: DataFrame, competitors: DataFrame, prices: DataFrame, fascia_id: int | None, status: str = "pending", limit: int = 200) -> DataFrame:
    """Matches of a status, the most confident first, with what they match."""
    asked(status)
    own = prices.where(F.col("fascia_id").eqNullSafe(F.lit(fascia_id))).select("product_id", F.col("price").alias("our_price"), F.col("currency").alias("site_currency"))
    named = products.select(F.col("id").alias("product_id"), "internal_sku", "product_name", "brand")
    shops = competitors.select(F.col("id").alias("competitor_id"), F.col("display_name").alias("competitor_name"))
    rows = matches.where(F.col("status") == status).join(named, "product_id").join(shops, "competitor_id").join(own, "product_id", "left")
    rows = rows.withColumn("currency", F.coalesce("site_currency", F.lit("GBP"))).drop("site_currency")
    return rows.orderBy(F.desc("confidence"), F.asc("id")).limit(max(1, min(limit, 500)))


def catalogue_status(products: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: live products, brands and last update (delisted ones too), products with a price, those awaiting one."""
    one = products.agg(
        F.count_if(F.col("delisted_at").isNull()).alias("products"),
        F.count_if(F.col("delisted_at").isNotNull()).alias("delisted"),
        F.count_if(F.col("delisted_at").isNull() & (F.col("source") == "manual")).alias("manual"),
        F.count_distinct(F.lower("brand")).alias("brands"),
        F.max("updated_at").alias("last_updated"),
    )
    both = one.crossJoin(prices.agg(F.count_distinct("product_id").alias("with_price")))
    return both.withColumn("awaiting_price", F.col("products") - F.col("with_price"))


def matching_status(matches: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    matched = F.count_distinct(F.when(F.col("status") == "confirmed", F.col("product_id"))).alias("products_matched")
    return matches.agg(n("confirmed"), n("pending"), n("rejected"), matched)


def competitor_status(competitors: DataFrame) -> DataFrame:
    """One row: shops, enabled ones and, where logos are known, those with one."""
    logos = [F.count("logo_data").alias("with_logo")] if "logo_data" in competitors.columns else []
    return competitors.agg(F.count("*").alias("competitors"), F.count_if("enabled").alias("enabled"), *logos)


def competitor_list(competitors: DataFrame) -> DataFrame:
    """Shops by name, with a flag in place of the logo itself."""
    flag = F.col("logo_data").isNotNull().alias("has_logo")
    return competitors.select(*[flag if c == "logo_data" else F.col(c) for c in competitors.columns]).orderBy("display_name", "slug")


def logo_refresh(results: DataFrame) -> DataFrame:
    """One row: how many shops' logos were fetched, failed, stayed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(n("fetched"), n("failed"), n("unchanged"))


def priced_everywhere(coverage: DataFrame) -> DataFrame:
    """One row: how many products every site prices at least (0 without sites), from fascia_coverage()."""
    return coverage.agg(F.coalesce(F.min("priced"), F.lit(0)).alias("priced_everywhere"), F.coalesce(F.bool_or(F.col("missing") > 0), F.lit(False)).alias("some_missing"))


def cached_urls(urls: DataFrame) -> DataFrame:
    """How many addresses of each shop are known."""
    return urls.groupBy("competitor_id").agg(F.count("*").alias("urls"))


def observation_status(observations: DataFrame) -> DataFrame:
    return observations.agg(F.count("*").alias("observations"), F.max("observed_at").alias("last_observed"))


def run_status(runs: DataFrame) -> DataFrame:
    latest = F.max_by("status", F.struct("started_at", "id")).alias("last_status")
    return runs.agg(F.count("*").alias("runs"), F.max("started_at").alias("last_started"), latest)


def fascia_coverage(fascias: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    """For each site the products priced and the live ones that are not; sites without prices stay."""
    live = products.agg(F.count_if(F.col("delisted_at").isNull()).alias("live"))
    per = fascias.join(prices.select("fascia_id", "product_id"), fascias["id"] == F.col("fascia_id"), "left")
    per = per.groupBy("code", "name").agg(F.count("product_id").alias("priced"))
    return per.crossJoin(live).select("code", "name", "priced", (F.col("live") - F.col("priced")).alias("missing"))


def fascia_priced(fascias: DataFrame, prices: DataFrame) -> DataFrame:
    """For each enabled site the number of its prices."""
    counts = prices.groupBy("fascia_id").agg(F.count("*").alias("priced"))
    return fascias.where("enabled").join(counts, fascias["id"] == counts["fascia_id"], "left").select("code", "name", F.coalesce("priced", F.lit(0)).alias("priced"))


def _named(rows: DataFrame, products: DataFrame | None, competitors: DataFrame | None) -> DataFrame:
    """Adds internal_sku, product_name and competitor_name, null where a row has none."""
    if products is not None:
        rows = rows.join(products.select(F.col("id").alias("product_id"), "internal_sku", "product_name"), "product_id", "left")
    if competitors is not None:
        rows = rows.join(competitors.select(F.col("id").alias("competitor_id"), F.col("display_name").alias("competitor_name")), "competitor_id", "left")
    return rows


def recent_runs(runs: DataFrame, products: DataFrame | None = None, competitors: DataFrame | None = None, limit: int = 25) -> DataFrame:
    """The last runs with the names of what they were for; names are joined to those few only."""
    order = [F.desc("started_at"), F.desc("id")]
    return _named(runs.orderBy(*order).limit(limit), products, competitors).orderBy(*order)


def items_errors_first(items: DataFrame, run_id: int, products: DataFrame | None = None, competitors: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """A run's items, errors first, with names."""
    order = [(F.col("status") == "error").desc(), F.asc("id")]
    return _named(items.where(F.col("run_id") == run_id).orderBy(*order).limit(limit), products, competitors).orderBy(*order)


def recent_errors(items: DataFrame, products: DataFrame | None = None, competitors: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """The last items that failed, with names."""
    order = [F.desc("created_at"), F.desc("id")]
    return _named(items.where(F.col("status") == "error").orderBy(*order).limit(limit), products, competitors).orderBy(*order)


def run_counters(items: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy("run_id").agg(n("ok"), n("error"), n("skipped"))


def stocks_brand(brands, brand):
    """Whether a shop that lists brands (none: all) stocks one, without regard to case."""
    return (F.size(brands) == 0) | F.exists(brands, lambda b: F.lower(b) == F.lower(brand))


#: A list of shops is met in arrays of so many blocks, each cut into runs of so many shops.
_ARRAYS, _RUN = 16, 256


def _met(products: DataFrame, lists: DataFrame, parts: int = 64, cut: bool = True) -> DataFrame:
    """products (product_id, key, ...) with shops, the arrays of their list (lists: key, competitor_id), each in order; cut: in runs.

    Each part of a list's products is given the list's arrays, so that products
    which all meet one list are spread over many tasks; shuffled are products once
    and shops once a part, pairs never.  Arrays are larger than Spark takes them
    for, so it may not choose to broadcast them.

    Cut arrays stand on the left: a run of shops meets all products of its part
    before the next run does.  Written to a column file, a product is then stored
    once for a run, and the run's shops, repeated within a page, compress to little.
    """
    block, at = F.pmod(F.xxhash64("competitor_id"), F.lit(_ARRAYS)), F.concat(F.col("part").cast("string"), F.lit(" "), "key").alias("at")
    arrays = lists.groupBy("key", block.alias("block")).agg(F.sort_array(F.collect_set("competitor_id")).alias("shops"))
    if cut:
        starts = F.sequence(F.lit(1), F.greatest(F.size("shops"), F.lit(1)), F.lit(_RUN))
        arrays = arrays.select("key", F.explode(F.transform(starts, lambda i: F.slice("shops", i, _RUN))).alias("shops"))
    arrays = arrays.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(at, "shops")
    placed = products.withColumn("part", F.pmod(F.xxhash64("product_id"), F.lit(parts))).select("*", at).drop("key", "part")
    placed = placed.repartition(many_tasks(products.sparkSession), "at")
    return arrays.hint("merge").join(placed, "at") if cut else placed.join(arrays.hint("merge"), "at")


def discovery_worklist(products: DataFrame, competitors: DataFrame, matches: DataFrame, limit: int = 0) -> DataFrame:
    """(product_id, competitor_id) of live products and enabled shops that stock the brand, without a live match.

    A product meets two lists of shops, those that stock its brand and those
    without a list of brands, less those that it has a match at.  Under a limit it
    shows the first shops of each array: more of one product are not needed.
    """
    live = products.where(F.col("delisted_at").isNull()).select(F.col("id").alias("product_id"), F.lower("brand").alias("b"))
    shops = competitors.where("enabled").select(F.col("id").alias("competitor_id"), "brands")
    of_brand, every = F.transform("brands", lambda b: F.concat(F.lit("="), F.lower(b))), F.array(F.lit("every"))
    lists = shops.select("competitor_id", F.explode(F.when(F.size("brands") == 0, every).otherwise(of_brand)).alias("key")).where("key IS NOT NULL")
    done = matches.where(F.col("status").isin("confirmed", "pending")).groupBy("product_id").agg(F.collect_set("competitor_id").alias("done"))
    none = F.array().cast(done.schema["done"].dataType)
    keys = F.explode(F.array_compact(F.array(F.lit("every"), F.concat(F.lit("="), "b"))))
    each = live.join(done.hint("merge"), "product_id", "left").select("product_id", F.coalesce("done", none).alias("done"), keys.alias("key"))
    # Nearly all pairs may be of one list, that of the shops without brands: with few parts, tasks would get unequal shares.
    met = _met(each, lists, parts=64 if limit else 256, cut=not limit)
    first = F.slice("shops", F.lit(1), F.lit(limit) + F.size("done")) if limit else F.col("shops")
    left = F.array_except(first, "done")
    return _first(met.select("product_id", F.explode(F.slice(left, 1, limit) if limit else left).alias("competitor_id")), limit, "product_id", "competitor_id")


def _first(work: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first pieces of work in an order; all of them, in no order, at a limit of 0."""
    return work.orderBy(*order).limit(limit) if limit else work


def brand_not_stocked(products: DataFrame, competitors: DataFrame) -> DataFrame:
    """(product_id, competitor_id) of live products and enabled shops that list brands, but not the product's: passed over by discovery.

    Counted by brand first: a brand's products meet only arrays of the shops that lack it.
    """
    live = products.where(F.col("delisted_at").isNull()).select(F.col("id").alias("product_id"), F.lower("brand").alias("key"))
    shops = competitors.where(F.col("enabled") & (F.size("brands") > 0)).select(F.col("id").alias("competitor_id"), F.transform("brands", lambda b: F.lower(b)).alias("listed"))
    lacking = live.select("key").distinct().crossJoin(shops).where(~F.array_contains("listed", F.col("key"))).select("key", "competitor_id")
    return _met(live, lacking).select("product_id", F.explode("shops").alias("competitor_id"))


def price_worklist(matches: DataFrame, products: DataFrame, limit: int = 0) -> DataFrame:
    """Confirmed matches of live products: the listings whose price is due, in order of their identifier under a limit."""
    live = products.where(F.col("delisted_at").isNull()).select(F.col("id").alias("product_id"), "internal_sku")
    return _first(matches.where(F.col("status") == "confirmed").join(live, "product_id"), limit, "id")


def feed_histogram(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs; blank and null count as 'unknown'."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))

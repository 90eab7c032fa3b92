"""The price comparison: our products against the latest observed prices of each competitor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions import labels, money, rules
from pricelake.sources.shared import workspace


def clamp_page(limit: int, offset: int, most: int = 500) -> tuple[int, int]:
    return max(1, min(limit, most)), max(0, offset)


def filter_products(products: DataFrame, brand: str | None = None, category: str | None = None, search: str | None = None, fields: tuple[str, ...] = ("product_name", "internal_sku", "brand", "ean_mpn")) -> DataFrame:
    """Live products; brand and category without regard to case; search is a pattern in any of the fields."""
    out = products.where(F.col("delisted_at").isNull())
    if brand is not None:
        out = out.where(F.lower("brand") == brand.lower())
    if category is not None:
        out = out.where(F.lower(F.coalesce("category", F.lit(""))) == category.lower())
    if search is not None:
        hit = F.lit(False)
        for name in fields:
            hit |= F.coalesce(F.col(name), F.lit("")).ilike(f"%{search}%")
        out = out.where(hit)
    return out


def with_site_price(products: DataFrame, prices: DataFrame, fascia_id: int | None) -> DataFrame:
    """Adds our_price, regular_price and currency at a site; products without a price there stay."""
    at = prices.where(F.col("fascia_id").eqNullSafe(F.lit(fascia_id)) & F.col("fascia_id").isNotNull())
    at = at.select("product_id", F.col("price").alias("our_price"), "regular_price", F.col("currency").alias("site_currency"))
    out = products.join(at, products["id"] == at["product_id"], "left").drop("product_id")
    return out.withColumn("currency", F.coalesce("site_currency", "currency")).drop("site_currency")


def latest_observations(observations: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The last observation of each product and competitor; of equals that with the largest identifier.

    products (id): only theirs, which is told before anything is sorted.
    """
    if products is not None:
        observations = observations.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return latest_of(observations, F.struct("observed_at", "run_id", "line"))


def latest_of(observations: DataFrame, order: Column, key: tuple[str, ...] = ("product_id", "competitor_id")) -> DataFrame:
    """The last observation of every pair in an order, of a table or of a stream; nothing is sorted, each task keeps one row a pair."""
    rest = [c for c in observations.columns if c not in key]
    best = observations.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*[F.col(c) if c in key else F.col("best")[c].alias(c) for c in observations.columns])


def competitor_prices(products: DataFrame, latest: DataFrame, competitors: DataFrame) -> DataFrame:
    """A row for each product and competitor that has a latest price: positions and deltas.

    products: (id, our_price, ...).  Disabled competitors count too.
    """
    seen = latest.join(products.select(F.col("id").alias("product_id"), "our_price"), "product_id")
    seen = seen.join(competitors.select(F.col("id").alias("competitor_id"), F.col("display_name").alias("competitor_name")), "competitor_id")
    ours, theirs = F.col("our_price"), F.col("price")
    return seen.select(
        "product_id",
        "competitor_id",
        "competitor_name",
        "price",
        "was_price",
        "promo",
        "in_stock",
        "observed_at",
        "our_price",
        money.classify_position(ours, theirs).alias("position"),
        money.delta_abs(ours, theirs).alias("delta_abs"),
        money.delta_pct(ours, theirs).alias("delta_pct"),
        money.purchasable(theirs, F.col("in_stock")).alias("purchasable"),
    )


_BEST = ("price", "competitor_id", "competitor_name", "position", "delta_abs", "delta_pct", "observed_at")


def cheapest(prices: DataFrame) -> DataFrame:
    """For each product the cheapest purchasable competitor, of equals that with the least identifier."""
    key = F.when(F.col("purchasable"), F.struct(*_BEST))
    best = prices.groupBy("product_id").agg(F.min(key).alias("best"))
    return best.select("product_id", *[F.col(f"best.{c}").alias(c) for c in _BEST])


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("product_id").agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "pending").alias("pending"))


def comparison(
    products: DataFrame, prices: DataFrame, observations: DataFrame, competitors: DataFrame, fascia_id: int | None, matches: DataFrame | None = None, nested: bool = False
) -> DataFrame:
    """A row for each given product: our price, the cheapest competitor and when it was seen, where we stand.

    matches: adds how many are confirmed and pending; nested: adds all
    competitors' prices as an array.
    """
    priced = with_site_price(products, prices, fascia_id)
    seen = competitor_prices(priced, latest_observations(observations, products), competitors)
    best = cheapest(seen).withColumnsRenamed({"price": "best_price", "competitor_id": "best_competitor_id", "competitor_name": "best_competitor"})
    out = priced.join(best.withColumnRenamed("product_id", "id"), "id", "left")
    if matches is not None:
        counts = match_counts(matches.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")).withColumnRenamed("product_id", "id")
        out = out.join(counts, "id", "left").fillna(0, ["confirmed", "pending"])
    if nested:
        out = out.join(nested_prices(seen).withColumnRenamed("product_id", "id"), "id", "left")
    return out.withColumn("our_price_missing", F.col("our_price").isNull())


def with_total(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """A page's rows, each with total, the number of rows that the page was cut from: a count beside the page, not a window over all."""
    return rows.crossJoin(whole.agg(F.count("*").alias("total")))


#: The last row of a page that is found by keeping the first rows; beyond it ranges of the order are counted first.
SHALLOW = 10_000


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset.. of an order that ends in a unique column.

    The first pages are the first rows, of which each task keeps its own few.  For
    a deep page that would be all rows before it, in one task: there the rows are
    dealt to ranges of the order, which are counted, and only those ranges are
    sorted that hold a row of the page.  Both give the same rows.
    """
    limit, offset = clamp_page(limit, offset)
    if offset + limit <= SHALLOW:
        return df.orderBy(*order).offset(offset).limit(limit)
    spark, path, n = df.sparkSession, workspace(df.sparkSession, "ranges"), df.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SHALLOW))
    df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before, at, wanted = 0, 0, []
    for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # a row a range
        if at + r.n > offset and at < offset + limit:
            before = at if not wanted else before
            wanted.append(r["_range"])
        at += r.n
    within = dealt.where(F.col("_range").between(wanted[0], wanted[-1]) if wanted else F.lit(False)).drop("_range")
    return within.orderBy(*order).offset(offset - before).limit(limit)


def product_page(products: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return page(products, [F.asc_nulls_last("brand"), F.asc_nulls_last("product_name"), F.asc("id")], limit, offset)


def at_position(rows: DataFrame, position: str | None) -> DataFrame:
    """lower, equal, higher; unmatched: no price seen; awaiting_price: none of ours.  Anything else keeps all."""
    if position in ("lower", "equal", "higher"):
        return rows.where(F.col("position") == position)
    if position == "unmatched":
        return rows.where(F.col("best_price").isNull())
    if position == "awaiting_price":
        return rows.where("our_price_missing")
    return rows


def asked(value: str, allowed: list[str] = rules.MATCH_STATUSES) -> str:
    """A status or mode that a query asks for; any other than those allowed is refused."""
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many products are lower, equal, higher, unmatched, without our price; the share that is matched."""
    n = F.count("*")
    matched = F.count_if(F.col("best_price").isNotNull())
    return rows.agg(
        n.alias("products"),
        F.count_if(F.col("position") == "lower").alias("lower"),
        F.count_if(F.col("position") == "equal").alias("equal"),
        F.count_if(F.col("position") == "higher").alias("higher"),
        F.count_if(F.col("best_price").isNull()).alias("unmatched"),
        F.count_if(F.col("our_price_missing")).alias("awaiting_price"),
        F.when(n == 0, F.lit(0.0)).otherwise(money.round2(matched / F.nullif(n, F.lit(0)) * 100)).alias("coverage_pct"),
    )


def nested_prices(prices: DataFrame) -> DataFrame:
    """For each product its competitors' prices as an array, by competitor."""
    entry = F.struct("competitor_id", "competitor_name", "price", "position", "delta_abs", "delta_pct")
    return prices.groupBy("product_id").agg(F.sort_array(F.collect_list(entry)).alias("competitor_prices"))


def history(observations: DataFrame, competitors: DataFrame, product_id: int, limit: int = 200) -> DataFrame:
    """A product's observations, the latest first."""
    named = competitors.select(F.col("id").alias("competitor_id"), F.col("display_name").alias("competitor_name"))
    rows = observations.where(F.col("product_id") == product_id).join(named, "competitor_id")
    order = [F.desc("observed_at"), F.desc("run_id"), F.desc("line")]
    return rows.orderBy(*order).limit(max(1, min(limit, 1000)))


# The columns of the export.
EXPORT_COLUMNS = [
    "internal_sku", "brand", "product_name", "category", "ean_mpn", "our_price", "currency",
    "best_competitor", "best_competitor_price", "position", "delta_gbp", "delta_pct", "observed_at",
]


def export(rows: DataFrame) -> DataFrame:
    """The columns of a CSV export; a product without a position reads 'unmatched', times are ISO texts."""
    named = rows.withColumnsRenamed({"best_price": "best_competitor_price", "delta_abs": "delta_gbp"})
    named = named.withColumn("position", F.coalesce("position", F.lit("unmatched"))).withColumn("observed_at", labels.iso_text(F.col("observed_at")))
    return named.select(*EXPORT_COLUMNS)


def csv_lines(rows: DataFrame) -> DataFrame:
    """Each row as a line (value) of CSV; quotes only where a value has a quote, a comma or a line end."""
    quoted = lambda x: F.when(x.rlike("[\",\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return rows.select(F.array_join(F.array(*[F.coalesce(quoted(F.col(c).cast("string")), F.lit("")) for c in rows.columns]), ",").alias("value"))


def csv_text(rows: DataFrame) -> str:
    """An export as one text with its byte order mark and header, in the rows' order; for pages only, whose size is bounded."""
    lines = [r.value for r in csv_lines(rows).collect()]
    return "\ufeff" + "\n".join([",".join(rows.columns), *lines])


def write_csv(rows: DataFrame, path: str) -> None:
    """Writes an export as UTF-8 CSV with a header; quotes only where a value needs them."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as JSON (value), nulls included, as a service answers."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def facets(products: DataFrame) -> DataFrame:
    """(facet, value): the brands and categories of live products."""
    live = products.where(F.col("delisted_at").isNull())
    each = [live.select(F.lit(c).alias("facet"), F.col(c).alias("value")).where(f"{c} is not null and {c} != ''").distinct() for c in ("brand", "category")]
    return each[0].union(each[1])


def default_fascia(fascias: DataFrame, code: str | None = None) -> DataFrame:
    """The enabled site of a code, or the first enabled one."""
    live = fascias.where("enabled")
    return (live if code is None else live.where(F.col("code") == code)).orderBy("code").limit(1)

"""The price monitor's tables, derived from the driver's: same expressions here and in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.functions import money, text
from pricelake.sources.shared import many_tasks


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.concat(F.lit("SKU-"), k.cast("string")).alias("internal_sku"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("product_name"),
        F.when(k % 5 != 0, (k + 7600000000000).cast("string")).alias("ean_mpn"),
        F.lit("GBP").alias("currency"),
        F.col("p_type").alias("category"),
        F.lit(None).cast("string").alias("our_product_url"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("specs"),
        F.when(k % 17 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("delisted_at"),
        F.when(k % 23 == 0, "manual").otherwise("feed").alias("source"),
        F.lit("2023-06-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    brands = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("BRAND#"), (k % 25 + 1).cast("string"))))
    return _read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("shop-"), k.cast("string")).alias("slug"), F.col("s_name").alias("display_name"),
        F.lit("https://x.co").alias("base_url"), (F.col("s_acctbal") >= 0).alias("enabled"), brands.alias("brands"),
    )


def fascias(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey").cast("long")
    return _read(spark, sf_dir, "region").select(k.alias("id"), k.cast("string").alias("code"), F.col("r_name").alias("name"), (k != 4).alias("enabled"))


def fascia_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product at each of the five sites, but for a quarter."""
    both = _read(spark, sf_dir, "part").crossJoin(F.broadcast(_read(spark, sf_dir, "region")))  # region has five rows
    r = F.col("r_regionkey").cast("long")
    return both.where((F.col("p_partkey") + r) % 4 != 0).select(
        F.col("p_partkey").alias("product_id"),
        r.alias("fascia_id"),
        money.round2(F.col("p_retailprice") * (1 + r / 100.0)).alias("price"),
        F.lit(None).cast("double").alias("regular_price"),
        F.lit(False).alias("on_sale"),
        F.lit("GBP").alias("currency"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(1)).otherwise(F.lit(2)).cast("long").alias("feed_import_id"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money.round2(F.col("l_extendedprice") / F.col("l_quantity"))
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("competitor_id"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("line"),
        price.alias("price"),
        money.round2(price * (1 + F.col("l_discount"))).alias("was_price"),
        (F.col("l_discount") > 0.05).alias("promo"),
        F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", False).alias("in_stock"),
        F.col("l_shipdate").alias("observed_at"),
    )


#: How many rows of the order lines a task takes where wide rows are made of narrow pairs.
PAIRS_A_TASK = 500_000


def matches(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """spread: in as many tasks as the order lines call for. Bare pairs are so narrow when shuffled that Spark would put
    them into few tasks, which then spill what the pairs become."""
    lines = _read(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("competitor_id"))
    if spread:
        pairs = pairs.repartition(max(many_tasks(spark), lines.count() // PAIRS_A_TASK), "product_id", "competitor_id")
    pairs = pairs.distinct()
    p, s = F.col("product_id"), F.col("competitor_id")
    status = F.when((p + s) % 3 == 0, "confirmed").when((p + s) % 3 == 1, "pending").otherwise("rejected")
    return pairs.select(
        (p * 100000 + s).alias("id"), p, s, F.concat(F.lit("https://x.co/"), p.cast("string"), F.lit("/"), s.cast("string")).alias("url"),
        ((p * 7 + s * 13) % 101).cast("int").alias("confidence"), F.lit("brand_spec_attributes").alias("tier"), status.alias("status"),
        F.when((p + s) % 6 == 0, "auto").when((p + s) % 6 == 3, "kim").alias("confirmed_by"), F.lit(None).cast("timestamp_ntz").alias("confirmed_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "running").when(s == "F", "completed").otherwise("failed")
    k = F.col("o_orderkey")
    of = lambda n, x: F.when(k % n != 0, x).cast("long")
    return _read(spark, sf_dir, "orders").select(
        k.alias("id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), of(3, k % 100 + 1).alias("competitor_id"), of(4, k % 200 + 1).alias("product_id")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "error", "error").when(t == "signup", "skipped").otherwise("ok")
    k = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        k.alias("id"), F.col("user_id").alias("run_id"), status.alias("status"), F.col("ts").alias("created_at"),
        F.when(k % 5 != 0, k % 200 + 1).cast("long").alias("product_id"), (k % 100 + 1).cast("long").alias("competitor_id"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    words = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    url = F.concat(F.lit("https://x.co/"), words(F.col("p_name")), F.lit("-"), words(F.col("p_brand")), F.lit("/p/"), k.cast("string"))
    return _read(spark, sf_dir, "part").select((k % 100).alias("competitor_id"), url.alias("url")).withColumn("slug", text.slug_words(F.col("url")))


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda n, yes, no: F.when(k % n == 0, yes).otherwise(no)
    return _read(spark, sf_dir, "part").select(
        k.alias("row_number"),
        F.when(k % 29 == 0, "").when(k % 31 == 0, "id").otherwise(F.concat(F.lit("SKU-"), (k + k % 2 * 1000000).cast("string"))).alias("id"),
        of(37, F.lit(""), F.col("p_name")).alias("title"),
        F.concat(F.col("p_retailprice").cast("string"), F.lit(" GBP")).alias("price"),
        of(3, F.lit("905.5 GBP"), F.lit("")).alias("sale_price"),
        of(6, F.lit("2030-01-01T00:00:00Z/2031-01-01T00:00:00Z"), F.lit("")).alias("sale_price_effective_date"),
        of(11, F.lit("FALSE"), F.lit("TRUE")).alias("price_visible"),
        F.col("p_brand").alias("brand"),
        of(7, F.lit("7.32E+11"), (k + 7320000000000).cast("string")).alias("gtin"),
        of(14, F.lit("4.5E+12"), F.concat(F.lit("M"), k.cast("string"))).alias("mpn"),
        of(4, F.lit(""), F.lit("in stock")).alias("availability"),
        F.col("p_type").alias("product_type"),
        F.col("p_size").cast("string").alias("Case Size"),
    )

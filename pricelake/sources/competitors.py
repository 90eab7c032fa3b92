"""Competitor files: one JSON document for each shop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """slug string, displayName string, baseUrl string, logoUrl string, searchUrlPattern string, enabled boolean,
scrapeFrequency string, brands array<string>, config struct<discovery string, rendering string, userAgent string,
rateLimit struct<minDelayMs int, jitterMs int, maxConcurrent int>, retry struct<attempts int, backoffMs int>,
product struct<useJsonLd boolean, sanityContains array<string>, selectors struct<title array<string>, price array<string>,
wasPrice array<string>, availability array<string>, promoBadge array<string>, ean array<string>>>,
search struct<resultItem array<string>, resultLink array<string>, resultTitle array<string>, resultPrice array<string>, maxCandidates int>>"""


def read_competitors(spark: SparkSession, path: str) -> DataFrame:
    """The shops of all files with defaults filled in; any fault in any file stops the whole read."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = (
        F.coalesce(F.col("slug").rlike("^[a-z0-9-]+$"), F.lit(False))
        & F.col("displayName").isNotNull()
        & F.coalesce(F.col("baseUrl").startswith("http"), F.lit(False))
        & F.coalesce(F.contains("searchUrlPattern", F.lit("{query}")), F.lit(False))
        & (F.coalesce("config.retry.attempts", F.lit(0)) <= 6)
        & (F.coalesce("config.search.maxCandidates", F.lit(10)) <= 50)
    )
    bad = [r.slug for r in raw.where(~ok).select("slug").limit(20).collect()]
    if bad:
        raise ValueError(f"competitor files with faults: {bad}")
    return raw.select(
        "slug",
        F.col("displayName").alias("display_name"),
        F.col("baseUrl").alias("base_url"),
        F.col("searchUrlPattern").alias("search_url_pattern"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("scrapeFrequency", F.lit("daily")).alias("scrape_frequency"),
        F.coalesce("brands", F.array().cast("array<string>")).alias("brands"),
        "config",
    ).orderBy("display_name", "slug")


def search_url(pattern, term):
    """A shop's search address for a term."""
    return F.replace(pattern, F.lit("{query}"), F.replace(F.url_encode(term), F.lit("+"), F.lit("%20")))

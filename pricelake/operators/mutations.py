"""Changes of state as functions from old snapshots to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import rules


def new_id(*key: str) -> Column:
    """An identifier for a new row from its key: the same wherever it is computed, and no counter that all tasks would have to share."""
    return F.xxhash64(*key).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)


def upsert_matches(matches: DataFrame, scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Matches after a scoring run, with all columns they had.

    Both have product_id, competitor_id, url, confidence, tier, status; matches
    also confirmed_by, and whatever else it has.  What the run tells (title, ean,
    evidence too, where it has them) follows the run; the status does not where a
    person decided or the match was rejected.  A pair has one confirmed match:
    where it had one before the run, other new confirmations wait for review; where
    it had none, the most confident of the new ones, of equals the least address,
    is it.  A new match has an identifier from its key, and is stamped with now
    where it is confirmed at once.  Of a run's rows for one address the most
    confident counts; a row whose key is not whole meets no other.

    No join: the run's rows lie beside the matches, and one sort by pair and address
    serves all windows.  The first asks for pairs, so that rows are shuffled once,
    and not at all where they lie by pairs already.
    """
    key, pair = ["product_id", "competitor_id", "url"], ["product_id", "competitor_id"]
    told = [c for c in ("confidence", "tier", "title", "ean", "evidence") if c in scored.columns]
    columns = [*matches.columns, *(c for c in told if c not in matches.columns)]
    both = matches.withColumn("_run", F.lit(False)).unionByName(scored.select(*key, *told, "status", F.lit(True).alias("_run")), allowMissingColumns=True)
    old, sort = ~F.col("_run"), ["_run", F.desc("confidence"), "status"]
    whole = F.col("product_id").isNotNull() & F.col("competitor_id").isNotNull() & F.col("url").isNotNull()
    everywhere = (Window.unboundedPreceding, Window.unboundedFollowing)
    was = F.coalesce(old & whole & (F.col("status") == "confirmed"), F.lit(False))
    taken = F.bool_or(was).over(Window.partitionBy(*pair).orderBy("url", *sort).rowsBetween(*everywhere))
    address = Window.partitionBy(*key).orderBy(*sort)
    mine = F.when(F.col("_run"), F.struct(*told, "status"))
    both = both.withColumn("_taken", taken).withColumns({"_new": F.when(whole, F.first(mine, True).over(address.rowsBetween(*everywhere))).otherwise(mine), "_at": F.row_number().over(address)})
    both = both.where(old | (F.col("_at") == 1) | ~whole)  # a run's row goes where there is a match, or a row before it
    decided = F.coalesce(old & ((F.col("confirmed_by").isNotNull() & (F.col("confirmed_by") != "auto")) | (F.col("status") == "rejected")), F.lit(False))
    asks, sure = F.coalesce((F.col("_new.status") == "confirmed") & ~decided, F.lit(False)), F.col("_new.confidence")
    first = F.struct(~F.col("_taken") & sure.isNull(), F.when(~F.col("_taken"), -sure), "url")  # of several confirmed before, the least address
    both = both.withColumn("_asks", asks)
    both = both.withColumn("_holder", F.min(F.when(F.when(F.col("_taken"), was).otherwise(F.col("_asks")), first)).over(Window.partitionBy(*pair)))
    holds = F.col("url").eqNullSafe(F.col("_holder.url"))
    status = F.when(F.col("_asks") & ~holds, "pending").otherwise(F.col("_new.status"))
    fresh, run = F.col("_run"), F.col("_new").isNotNull()
    at_once = fresh & (status == "confirmed")
    out = {c: F.when(run, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in told}
    out["status"] = F.when(old & F.col("status").isNotNull() & (decided | ~run), F.col("status")).otherwise(status)
    out["confirmed_by"] = F.when(at_once, "auto").otherwise(F.col("confirmed_by"))
    if "id" in matches.columns:
        out["id"] = F.coalesce("id", new_id(*key))
    if now is not None:
        stamps = {"confirmed_at": at_once, "created_at": fresh, "updated_at": run}
        out |= {c: F.when(when, now).otherwise(F.col(c)) for c, when in stamps.items() if c in matches.columns}
    return both.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in columns])


def confirm_match(matches: DataFrame, match_id: int, by: str, now: Column) -> DataFrame:
    """Confirms one match; the pair's other confirmed match is rejected and keeps its stamp."""
    chosen = matches.where(F.col("id") == match_id).select("product_id", "competitor_id", F.lit(True).alias("chosen"))
    out = matches.join(F.broadcast(chosen), ["product_id", "competitor_id"], "left")  # one row
    this = F.col("id") == match_id
    status = F.when(this, "confirmed").when(F.col("chosen") & (F.col("status") == "confirmed"), "rejected").otherwise(F.col("status"))
    stamped = out.withColumn("status", status).withColumn("confirmed_by", F.when(this, by).otherwise(F.col("confirmed_by")))
    return stamped.withColumn("confirmed_at", F.when(this, now).otherwise(F.col("confirmed_at"))).select(*matches.columns)


def reject_match(matches: DataFrame, match_id: int) -> DataFrame:
    return matches.withColumn("status", F.when(F.col("id") == match_id, "rejected").otherwise(F.col("status")))


def add_manual_match(matches: DataFrame, product_id: int, competitor_id: int, url: str, base_url: str, scored: DataFrame | None = None) -> DataFrame:
    """Matches with a link given by a person, pending, and all columns they had; a known address keeps its tier and status.

    scored: one row of what reading the page told (confidence, and title, ean,
    evidence where it has them), which a known address takes over.
    """
    if not url.startswith(base_url):
        raise ValueError(f"{url} is not an address of {base_url}")
    spark, key = matches.sparkSession, ["product_id", "competitor_id", "url"]
    told = [c for c in ("confidence", "title", "ean", "evidence") if scored is not None and c in scored.columns and c in matches.columns]
    row = spark.createDataFrame([(product_id, competitor_id, url)], "product_id long, competitor_id long, url string")
    row = row.crossJoin(scored.select(*[F.col(c).alias(f"n_{c}") for c in told]).limit(1)) if told else row  # one row each
    both = matches.withColumn("_there", F.lit(True)).join(row.withColumn("_given", F.lit(True)), key, "full_outer")
    fresh, given = F.col("_there").isNull(), F.col("_given").isNotNull()
    out = {c: F.when(given, F.col(f"n_{c}")).otherwise(F.col(c)) for c in told}
    first = {"tier": F.lit("manual"), "status": F.lit("pending")} | ({} if "confidence" in told else {"confidence": F.lit(0)}) | ({"id": new_id(*key)} if "id" in matches.columns else {})
    out |= {c: F.when(fresh, v).otherwise(F.col(c)) for c, v in first.items()}
    return both.select(*[(out[c] if c in out else F.col(c)).cast(t.dataType).alias(c) for t in matches.schema.fields for c in [t.name]])


def delete_products(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without products (column id): their matches, observations and prices go, run items stay without product."""
    of = gone.select(F.col("id").alias("product_id")).distinct()
    out = {"products": tables["products"].join(gone.select("id").distinct(), "id", "left_anti")}
    for name in ("matches", "observations", "prices"):
        if name in tables:
            out[name] = tables[name].join(of, "product_id", "left_anti")
    for name in ("runs", "items"):
        if name in tables:
            kept = tables[name].join(of.withColumn("gone", F.lit(True)), "product_id", "left")
            out[name] = kept.withColumn("product_id", F.when(F.col("gone").isNull(), F.col("product_id"))).select(*tables[name].columns)
    return out


def delete_runs(runs: DataFrame, items: DataFrame, observations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without runs (column id) that have ended: their items go, observations stay without run; a running run stays."""
    ended = runs.where("status != 'running'").join(gone.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("run_id"))
    kept = runs.join(ended, runs["id"] == ended["run_id"], "left_anti")
    seen = observations.join(ended.withColumn("gone", F.lit(True)), "run_id", "left")
    seen = seen.withColumn("run_id", F.when(F.col("gone").isNull(), F.col("run_id"))).select(*observations.columns)
    return kept, items.join(ended, "run_id", "left_anti"), seen


def remove_competitor_price(observations: DataFrame, matches: DataFrame, product_id: int | None = None, competitor_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Without a product's (a competitor's, all) observations and matches; rejected matches stay."""
    hit = F.lit(True)
    for name, value in (("product_id", product_id), ("competitor_id", competitor_id)):
        if value is not None:
            hit &= F.col(name) == value
    return observations.where(~hit), matches.where(~(hit & (F.col("status") != "rejected")))


def upsert_urls(urls: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """(competitor_id, url, slug, first_seen_at, last_seen_at) after a harvest; what was not seen again stays as it was."""
    key = ["competitor_id", "url"]
    new = seen.groupBy(*key).agg(F.min("slug").alias("n_slug"))
    both = urls.join(new, key, "full_outer")
    again = F.col("n_slug").isNotNull()
    return both.select(*key, F.coalesce("n_slug", "slug").alias("slug"), F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(again, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def sync_competitors(competitors: DataFrame, files: DataFrame) -> DataFrame:
    """Competitors after reading their files, with all columns they had.

    A known shop follows its file, but for enabled, which stays as it was set, and
    a logo's address where the file names none.  What a file does not tell (id,
    the logo) stays; a new shop has an identifier from its slug.
    """
    known = [c for c in files.columns if c in competitors.columns and c != "slug"]
    new = files.select("slug", *[F.col(c).alias(f"n_{c}") for c in known], F.lit(True).alias("_file"))
    both = competitors.withColumn("_there", F.lit(True)).join(new, "slug", "full_outer")
    first = ("enabled",)  # the shop's own value counts before the file's

    def value(c: str) -> Column:
        if c == "id":
            return F.coalesce("id", new_id("slug"))
        if c not in known:
            return F.col(c)
        if c in first:
            return F.coalesce(c, f"n_{c}")
        return F.coalesce(f"n_{c}", c) if c == "logo_url" else F.when(F.col("_file"), F.col(f"n_{c}")).otherwise(F.col(c))

    return both.select(*[value(c).alias(c) for c in competitors.columns])


def set_enabled(competitors: DataFrame, slug: str, enabled: bool) -> DataFrame:
    return competitors.withColumn("enabled", F.when(F.col("slug") == slug, enabled).otherwise(F.col("enabled")))


def add_manual_product(
    products: DataFrame, prices: DataFrame, sku: str, brand: str, name: str, price: float | None = None, fascia_id: int | None = None,
    identifier: str | None = None, category: str | None = None, url: str | None = None, reference: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(products, prices) with one more product, typed in by a person; its SKU must be new whatever the letters' case.

    A price is stored at the site that it is given for; blank texts count as not
    given, a reference number is an attribute.
    """
    if price is not None and (price < 0 or fascia_id is None):
        raise ValueError("a price needs a site, and cannot be negative")
    if not products.where(F.lower("internal_sku") == sku.lower()).isEmpty():
        raise ValueError(f"there is a product {sku} already")
    given = lambda x: F.lit((x or "").strip() or None).cast("string")
    known = F.map_filter(F.create_map(F.lit("reference_number"), given(reference)), lambda _, v: v.isNotNull())
    values = {"internal_sku": F.lit(sku), "brand": F.lit(brand), "product_name": F.lit(name), "ean_mpn": given(identifier), "category": given(category), "our_product_url": given(url), "specs": known, "source": F.lit("manual")}
    row = products.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    out = products.unionByName(row.select("id", *[v.alias(c) for c, v in values.items() if c in products.columns]), allowMissingColumns=True)
    if price is None:
        return out, prices
    own = row.select(F.col("id").alias("product_id"), F.lit(fascia_id).cast("long").alias("fascia_id"), F.lit(float(price)).alias("price"), F.lit("GBP").alias("currency"))
    return out, prices.unionByName(own, allowMissingColumns=True)


def removed(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, removed): how many rows of each table a change of state took away."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    each = [count(before[t], "b").crossJoin(count(after[t], "a")).select(F.lit(t).alias("table"), (F.col("b") - F.col("a")).alias("removed")) for t in sorted(after)]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out


def set_logos(competitors: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Competitors after looking for logos.  found: (slug, data, content_type, source, error), a row for each shop that was tried.

    What was found replaces the logo and clears the error; a failure leaves the
    logo and keeps the error.
    """
    new = found.select("slug", F.col("data").alias("n_data"), F.col("content_type").alias("n_type"), F.col("source").alias("n_source"), F.col("error").alias("n_error"), F.lit(True).alias("tried"))
    got = F.col("n_data").isNotNull()
    pick = lambda a, b: F.when(got, F.col(a)).otherwise(F.col(b)).alias(b)
    out = competitors.join(new, "slug", "left")
    rest = [c for c in competitors.columns if c not in ("logo_data", "logo_content_type", "logo_url", "logo_fetched_at", "logo_error")]
    error = F.when(got, None).when(F.col("tried"), F.col("n_error")).otherwise(F.col("logo_error")).alias("logo_error")
    return out.select(*rest, pick("n_data", "logo_data"), pick("n_type", "logo_content_type"), pick("n_source", "logo_url"), F.when(got, now).otherwise(F.col("logo_fetched_at")).alias("logo_fetched_at"), error)


def clear_logo(competitors: DataFrame, slug: str) -> DataFrame:
    """A shop without its logo and all that is known of it."""
    gone = lambda c: F.when(F.col("slug") != slug, F.col(c)).alias(c)
    logo = ("logo_data", "logo_content_type", "logo_url", "logo_fetched_at", "logo_error")
    return competitors.select(*[gone(c) if c in logo else F.col(c) for c in competitors.columns])


def start_run(runs: DataFrame, mode: str, now: Column, competitor_id: int | None = None, product_id: int | None = None) -> DataFrame:
    """Runs with one more that has just begun; a mode that there isn't is refused."""
    if mode not in rules.RUN_MODES:
        raise ValueError(f"mode must be one of {', '.join(rules.RUN_MODES)}, not {mode!r}")
    row = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    values = {"mode": F.lit(mode), "status": F.lit("running"), "started_at": now, "competitor_id": F.lit(competitor_id).cast("long"), "product_id": F.lit(product_id).cast("long")}
    return runs.unionByName(row.select("id", *[v.alias(c) for c, v in values.items()]), allowMissingColumns=True)


def run_states(events: DataFrame) -> DataFrame:
    """Runs from their events (run_id, event: started, completed or failed, at): the last event tells the state."""
    last = F.max_by("event", "at")
    return events.groupBy("run_id").agg(
        F.when(last == "started", "running").otherwise(last).alias("status"),
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("event") != "started", F.col("at"))).alias("finished_at"),
    )

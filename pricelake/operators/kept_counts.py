"""Distinct counts that are kept as bitmaps and brought up to date by what changed, not by counting again.

A member is a row (measure, part, key): product key has a price at site part, or a
confirmed match at shop part, or is live (part 0).  Each (measure, part) keeps
bitmaps of its keys' numbers, a row for each 32,768 numbers; within a part a key
is a member once or not at all, so a bit can be set and cleared.  What several
parts hold together is the union of their bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.sources.shared import dealt_out

_AT = ["measure", "part", "bucket"]
_DIGITS = "0123456789ABCDEF"


def number_keys(keys: DataFrame, known: DataFrame | None = None, spread: int = 4096) -> DataFrame:
    """(key, number): those known, unchanged, and the next numbers for keys that have none.

    Numbers are positive, nearly gapless and the same whenever a task runs again:
    a key's hash says which of spread series it is in, its place there follows by
    key.  spread must be the same for all calls that add to one table.  Null keys
    get no number.
    """
    new = dealt_out(keys.select(F.col(keys.columns[0]).cast("long").alias("key")).where("key IS NOT NULL"), "key").distinct()
    series = F.pmod(F.xxhash64("key"), F.lit(spread))
    if known is None:
        new = new.withColumns({"series": series, "taken": F.lit(0).cast("long")})
    else:
        last = F.max(F.floor((F.col("number") - 1) / spread) + 1).alias("taken")
        used = known.groupBy(F.pmod(F.col("number") - 1, F.lit(spread)).alias("series")).agg(last)
        new = new.join(known.select("key"), "key", "left_anti").withColumn("series", series)
        new = new.join(used, "series", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("series").orderBy("key")) - 1 + F.col("taken")
    numbered = new.select("key", (place * spread + F.col("series") + 1).cast("long").alias("number"))
    return numbered if known is None else known.select("key", "number").union(numbered)


def members(products: DataFrame | None = None, prices: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """(measure, part, key) of the given tables' rows.

    live, manual (live ones), delisted: products; priced: products by site;
    matched: products with a confirmed match, by shop (a pair has one).  Rows
    alike in all three are one member.
    """
    row = lambda t, measure, part, key: t.select(F.lit(measure).alias("measure"), F.col(part).cast("long").alias("part") if part else F.lit(0).cast("long").alias("part"), F.col(key).cast("long").alias("key"))
    out = []
    if products is not None:
        live = products.where("delisted_at IS NULL")
        out += [row(live, "live", None, "id"), row(live.where("source = 'manual'"), "manual", None, "id"), row(products.where("delisted_at IS NOT NULL"), "delisted", None, "id")]
    if prices is not None:
        out.append(row(prices, "priced", "fascia_id", "product_id"))
    if matches is not None:
        out.append(row(matches.where("status = 'confirmed'"), "matched", "competitor_id", "product_id"))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(measure, part, key, member): what became a member and what is none any more.

    before and after: members of the rows that a change touched, as they were and
    as they are; a row that stays a member says nothing, however often it is given.
    """
    sides = before.withColumn("side", F.lit(-1)).union(after.withColumn("side", F.lit(1)))
    moved = dealt_out(sides, "measure", "part", "key").groupBy("measure", "part", "key").agg((F.max("side") + F.min("side")).alias("side")).where("side != 0")
    return moved.select("measure", "part", "key", (F.col("side") > 0).alias("member"))


def _placed(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """rows with bucket and bit in place of key, a bucket's rows in one task; a key without number is an error, as it would be lost."""
    lost = F.raise_error(F.concat(F.lit("no number for key "), F.col("key").cast("string"))).cast("long")
    number = F.coalesce("number", lost)
    placed = dealt_out(rows, "key").join(numbers.hint("merge"), "key", "left").withColumns({"bucket": F.bitmap_bucket_number(number), "bit": F.bitmap_bit_position(number)})
    # An aggregate of bitmaps sorts its rows: where they are, a task would sort all that it reads; dealt out, it sorts its share.
    return dealt_out(placed.drop("key", "number"), *_AT)


def keep(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(measure, part, bucket, bitmap) of members (measure, part, key)."""
    return _placed(rows.where("key IS NOT NULL"), numbers).groupBy(*_AT).agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _without(bitmap: str) -> Column:
    """The bitmap's complement."""
    return F.unhex(F.translate(F.hex(bitmap), _DIGITS, _DIGITS[::-1]))


def bring_up_to_date(kept: DataFrame, changes: DataFrame, numbers: DataFrame) -> DataFrame:
    """The bitmaps after changes (measure, part, key, member): one row at most a member.

    Setting a bit that is set, or clearing one that is not, changes nothing, so
    the same changes may come again.  Only buckets with cleared bits are taken
    apart; all are grouped once.
    """
    moved = _placed(changes.where("key IS NOT NULL"), numbers).groupBy(*_AT, "member").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    rows = kept.select(*_AT, F.lit(True).alias("member"), "bitmap").union(moved.select(*_AT, "member", "bitmap"))
    of = lambda member: F.bitmap_or_agg(F.when(F.col("member") == member, F.col("bitmap")))
    both = rows.groupBy(*_AT).agg(of(True).alias("set"), of(False).alias("cleared"), F.bool_or(~F.col("member")).alias("touched"))
    sides = F.when(F.col("touched"), F.array(F.col("set"), _without("cleared"))).otherwise(F.array("set"))
    return both.select(*_AT, F.explode(sides).alias("side")).groupBy(*_AT).agg(F.bitmap_and_agg("side").alias("bitmap"))


def count_by_part(kept: DataFrame) -> DataFrame:
    """(measure, part, n): each part's members; a part that lost all of them has 0."""
    return kept.groupBy("measure", "part").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def count_across(kept: DataFrame) -> DataFrame:
    """(measure, n): distinct keys over all parts."""
    return kept.groupBy("measure", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).groupBy("measure").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def kept_status(kept: DataFrame) -> DataFrame:
    """One row: live, delisted and manual products, those with a price, awaiting one, with a confirmed match."""
    n = lambda measure: F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))
    one = count_across(kept).agg(n("live").alias("products"), n("delisted").alias("delisted"), n("manual").alias("manual"), n("priced").alias("with_price"), n("matched").alias("products_matched"))
    return one.withColumn("awaiting_price", F.col("products") - F.col("with_price"))


def kept_coverage(kept: DataFrame, fascias: DataFrame) -> DataFrame:
    """For each site the products priced and the live ones that are not, from the bitmaps; sites without prices stay."""
    parts = count_by_part(kept.where("measure IN ('priced', 'live')"))
    live = parts.agg(F.coalesce(F.sum(F.when(F.col("measure") == "live", F.col("n"))), F.lit(0)).alias("live"))
    priced = parts.where("measure = 'priced'").select(F.col("part").alias("id"), F.col("n").alias("priced"))
    rows = fascias.join(priced, "id", "left").crossJoin(live)  # live is one row
    return rows.select("code", "name", F.coalesce("priced", F.lit(0)).alias("priced"), (F.col("live") - F.coalesce("priced", F.lit(0))).alias("missing"))

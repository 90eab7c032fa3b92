import random

import pytest
from pyspark.sql import functions as F

from pricelake.operators import kept_counts as kc

MEMBER = "measure string, part long, key long"


def table(spark, rows, schema=MEMBER):
    return spark.createDataFrame(sorted(rows), schema)


def by_part(kept):
    return {(r.measure, r.part): r.n for r in kc.count_by_part(kept).collect() if r.n}


def across(kept):
    return {r.measure: r.n for r in kc.count_across(kept).collect() if r.n}


def counted(rows):
    parts, keys = {}, {}
    for measure, part, key in rows:
        parts[measure, part] = parts.get((measure, part), 0) + 1
        keys.setdefault(measure, set()).add(key)
    return parts, {k: len(x) for k, x in keys.items()}


def test_numbers_stay_and_grow_without_gaps(spark):
    keys = spark.range(5_000).select((F.xxhash64("id")).alias("id"))
    first = kc.number_keys(keys, spread=16)
    got = {r.key: r.number for r in first.collect()}
    assert len(got) == len(set(got.values())) == 5_000 and min(got.values()) >= 1 and max(got.values()) < 6_500
    more = keys.union(spark.range(5_000, 8_000).select(F.xxhash64("id"))).union(spark.createDataFrame([(None,)], "id long"))
    again = {r.key: r.number for r in kc.number_keys(more, first, spread=16).collect()}
    assert {k: again[k] for k in got} == got and len(set(again.values())) == len(again) == 8_000 and max(again.values()) < 9_500
    assert kc.number_keys(keys.where("false")).count() == 0


def test_bitmaps_follow_any_changes(spark):
    rng = random.Random(5)
    keys = [rng.randrange(2**62) for _ in range(300)] + list(range(40))
    numbers = spark.createDataFrame([(k, 1 + i * 331) for i, k in enumerate(keys)], "key long, number long")  # several buckets
    some = lambda n: {(rng.choice(["priced", "matched"]), rng.randrange(3), rng.choice(keys)) for _ in range(n)}
    now = some(600)
    kept = kc.keep(table(spark, now), numbers)
    assert (by_part(kept), across(kept)) == counted(now)
    for _ in range(3):
        gone, new = set(rng.sample(sorted(now), 90)), some(80)
        after = (now - gone) | new
        # What a change touched: what went and came, and rows that it left as they were.
        touched = gone | (new & now) | set(rng.sample(sorted(now), 20))
        changes = kc.membership_changes(table(spark, touched & now), table(spark, (touched & after) | new))
        assert {(r.measure, r.part, r.key, r.member) for r in changes.collect()} == {(*x, False) for x in now - after} | {(*x, True) for x in after - now}
        rows = kc.bring_up_to_date(kept, changes, numbers).collect()
        kept = spark.createDataFrame(rows, "measure string, part long, bucket long, bitmap binary")
        assert (by_part(kept), across(kept)) == counted(after)
        again = kc.bring_up_to_date(kept, changes, numbers)  # the same changes once more
        assert (by_part(again), across(again)) == counted(after)
        now = after


def test_nulls_repeats_and_nothing(spark):
    numbers = spark.createDataFrame([(7, 1), (8, 40_000)], "key long, number long")
    rows = table(spark, [("priced", 1, 7), ("priced", 1, 7), ("priced", 2, 8)]).union(spark.createDataFrame([("priced", 1, None)], MEMBER))
    kept = kc.keep(rows, numbers)
    assert by_part(kept) == {("priced", 1): 1, ("priced", 2): 1} and across(kept) == {"priced": 2}
    none = table(spark, [], "measure string, part long, key long, member boolean")
    assert by_part(kc.bring_up_to_date(kept, none, numbers)) == by_part(kept)
    every = table(spark, [("priced", 1, 7, False), ("priced", 2, 8, False)], "measure string, part long, key long, member boolean")
    assert across(kc.bring_up_to_date(kept, every, numbers)) == {}
    empty = kc.keep(rows.where("false"), numbers)
    assert kc.kept_status(empty).collect()[0].asDict() == {"products": 0, "delisted": 0, "manual": 0, "with_price": 0, "products_matched": 0, "awaiting_price": 0}
    with pytest.raises(Exception, match="no number for key"):
        kc.keep(table(spark, [("priced", 1, 99)]), numbers).collect()


def test_bitmaps_are_sorted_in_many_tasks(spark):
    rows = spark.range(4000, numPartitions=1).select(F.when(F.col("id") % 2 == 0, "matched").otherwise("priced").alias("measure"), (F.col("id") % 100).alias("part"), F.col("id").alias("key"))
    numbers = kc.number_keys(rows.select("key"))
    kept = kc.keep(rows, numbers).withColumn("p", F.spark_partition_id()).collect()
    assert len(kept) == 100 and len({r.p for r in kept}) >= 12
    changes = kc.membership_changes(rows.where("key < 3").union(rows.where("key < 2")), rows.where("key IN (1, 3)"))
    assert sorted((r.key, r.member) for r in changes.collect()) == [(0, False), (2, False), (3, True)]

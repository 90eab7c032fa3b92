import os
import random

from pyspark.sql import functions as F

from pricelake.operators import feed, mutations
from pricelake.plans import views as v
from pricelake.plans.catalogue import QUERIES
from pricelake.sources.snapshots import Conflict, SnapshotLog
from pricelake.streaming import observations as live

SF = "/root/testdata/sf0.001"
MATCH = "id long, product_id long, competitor_id long, url string, confidence int, tier string, status string, confirmed_by string"
RUN = "product_id long, competitor_id long, url string, confidence int, tier string, status string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_listings_shuffle_bare_pairs_only(spark):
    plan = plan_of(QUERIES["match_upsert_two_listings"](spark, SF))
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert "Join" not in plan and len(exchanges) == 2 and all("REPARTITION" in x for x in exchanges)
    rows = spark.range(100).select("id", F.col("id").alias("product_id"), F.col("id").alias("competitor_id"), F.lit("u").alias("url"), F.lit(1).alias("confidence"), F.lit("t").alias("tier"), F.lit("pending").alias("status"), F.lit("x").alias("confirmed_by"))
    plan = plan_of(mutations.upsert_matches(rows, rows.drop("id", "confirmed_by")))
    assert "Join" not in plan and plan.count("Exchange") == 1


def told(old, run):
    """The matches after a run, one after the other."""
    rows = {(r[1], r[2], r[3]): r for r in old}
    new = {(r[0], r[1], r[2]): r for r in run}
    decided = {k for k, r in rows.items() if r[7] not in (None, "auto") or r[6] == "rejected"}
    held, best, out = {}, {}, {}
    for k, r in rows.items():
        if r[6] == "confirmed":
            held[k[:2]] = min(held.get(k[:2], k[2]), k[2])
    asks = {k for k, r in new.items() if r[5] == "confirmed" and k not in decided}
    for k in asks:
        rank = (new[k][3] is None, -(new[k][3] or 0), k[2])
        best[k[:2]] = min(best.get(k[:2], rank), rank)
    for k in rows.keys() | new.keys():
        status = rows[k][6] if k in rows and (k in decided or k not in new) else new[k][5]
        if k in asks and k[2] != (held[k[:2]] if k[:2] in held else best[k[:2]][2]):
            status = "pending"
        by = rows[k][7] if k in rows else "auto" if status == "confirmed" else None
        out[k] = (new[k][3] if k in new else rows[k][4], status, by)
    return out


def test_matches_after_a_run_one_after_the_other(spark):
    rng = random.Random(5)
    keys = [(p, c, u) for p in range(12) for c in range(4) for u in "abcd"]
    conf, status = (lambda: rng.choice([None, 1, 2, 3])), (lambda *more: rng.choice(["confirmed", "pending", *more]))
    old = [(i, *k, conf(), "t", status("rejected"), rng.choice([None, "auto", "kim"])) for i, k in enumerate(rng.sample(keys, 110))]
    run = [(*k, conf(), "n", status()) for k in rng.sample(keys, 110)]
    got = mutations.upsert_matches(spark.createDataFrame(old, MATCH), spark.createDataFrame(run, RUN)).collect()
    assert {(r.product_id, r.competitor_id, r.url): (r.confidence, r.status, r.confirmed_by) for r in got} == told(old, run) and len(got) == len(told(old, run))
    assert {r.id for r in got} >= {r[0] for r in old} and all(r.id is not None for r in got)


def test_an_address_twice_in_a_run_is_one_match_and_half_keys_meet_none(spark):
    old = spark.createDataFrame([(1, 1, 1, "a", 5, "t", "pending", None), (2, 1, 1, None, 5, "t", "pending", None), (3, None, 1, "z", 5, "t", "confirmed", None)], MATCH)
    run = [(1, 1, "a", 70, "n", "pending"), (1, 1, "a", 90, "n", "confirmed"), (1, 1, "b", 60, "n", "pending"), (1, 1, "b", 65, "n", "pending"), (1, 1, None, 50, "n", "pending"), (None, 1, "z", 50, "n", "pending")]
    got = mutations.upsert_matches(old, spark.createDataFrame(run, RUN)).collect()
    want = [(None, 1, "z", 5, "confirmed"), (None, 1, "z", 50, "pending"), (1, 1, None, 5, "pending"), (1, 1, None, 50, "pending"), (1, 1, "a", 90, "confirmed"), (1, 1, "b", 65, "pending")]
    assert sorted(map(str, ((r.product_id, r.competitor_id, r.url, r.confidence, r.status) for r in got))) == sorted(map(str, want))


def test_a_kept_feed_is_parsed_once(spark, tmp_path):
    state, rows, now = {"products": v.products(spark, SF), "prices": v.fascia_prices(spark, SF)}, v.feed_rows(spark, SF), F.lit("2026-08-09 12:00:00").cast("timestamp_ntz")
    kept = []

    def keep(df):
        kept.append(f"{tmp_path}/parsed-{len(kept)}")
        df.write.parquet(kept[-1])
        return spark.read.parquet(kept[-1])

    out, plain = feed.run_import(state, rows, 1, 3, now, keep=keep), feed.run_import(state, rows, 1, 3, now)
    assert len(kept) == 1
    for name in ("products", "prices", "imports", "counters"):
        assert "price_visible" not in plan_of(out[name])
        assert sorted(map(str, out[name].collect())) == sorted(map(str, plain[name].collect()))


def test_a_confirmation_shuffles_no_matches(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(mutations.confirm_match(spark.createDataFrame([], MATCH + ", confirmed_at timestamp_ntz"), 1, "kim", F.lit(None).cast("timestamp_ntz")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_streams_keep_no_state_beside_their_table(spark, tmp_path, monkeypatch):
    log, pairs, items = SnapshotLog(spark, f"{tmp_path}/log"), "product_id long, competitor_id long, run_id long", "id long, run_id long, status string"
    whole, lost = SnapshotLog.commit, []

    def late(self, operation, *args, **kwargs):
        if operation.endswith("batch 1") and operation not in lost:  # another writer was first
            lost.append(operation)
            raise Conflict(operation)
        return whole(self, operation, *args, **kwargs)

    monkeypatch.setattr(SnapshotLog, "commit", late)
    for k in range(2):
        spark.createDataFrame([(1, None, 5 - k), (1, 1, k)], pairs).write.mode("append").parquet(f"{tmp_path}/pairs")
        spark.createDataFrame([(2 * k, None, "ok"), (2 * k + 1, 3, "error")], items).write.mode("append").parquet(f"{tmp_path}/items")
        live.live_latest(spark.readStream.schema(pairs).parquet(f"{tmp_path}/pairs"), log, "latest", f"{tmp_path}/cp1", F.col("run_id")).awaitTermination()
        live.live_counters(spark.readStream.schema(items).parquet(f"{tmp_path}/items"), log, "counters", f"{tmp_path}/cp2").awaitTermination()
    assert sorted(map(str, map(tuple, log.read("latest").collect()))) == ["(1, 1, 1)", "(1, None, 5)"]
    assert sorted(map(str, map(tuple, log.read("counters").collect()))) == ["(3, 0, 2, 0)", "(None, 2, 0, 0)"]
    assert len(lost) == 2 and not any(os.path.exists(f"{tmp_path}/{c}/state") for c in ("cp1", "cp2"))

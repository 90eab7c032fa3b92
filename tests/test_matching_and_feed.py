import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricelake.operators import feed, matching, mutations

PAIR = "brand string, product_name string, ean_mpn string, category string, specs map<string,string>, title string, listing_ean string, listing_brand string, attributes map<string,string>"
WATCH = {"model": "Carrera", "case_size": "41mm", "dial_colour": "Blue", "case_material": "Stainless steel", "movement": "Automatic", "water_resistance": "100m"}


def scored(spark, title, ean=None, brand=None, attributes=None, specs=WATCH, ours="7612345678901", category="watches", name="Carrera Chronograph 41mm", of="TAG Heuer"):
    row = (of, name, ours, category, specs, title, ean, brand, attributes)
    return matching.score_candidates(spark.createDataFrame([row], PAIR)).first()


def names(found):
    return {x.attribute for x in found}


def test_identifiers_decide(spark):
    same = scored(spark, "anything", ean="7612-3456 78901")
    assert (same.confidence, same.tier, same.viable, same.auto_accept) == (100, "ean_mpn_exact", True, True)
    other = scored(spark, "TAG Heuer Carrera", ean="999", brand="TAG Heuer")
    assert (other.confidence, other.viable, other.evidence.gates_failed) == (0, False, ["ean_mpn"])


def test_gates_and_attributes(spark):
    wrong = scored(spark, "Omega Speedmaster", brand="Omega")
    assert wrong.confidence == 0 and wrong.evidence.gates_failed == ["brand"] and not wrong.viable
    silent = scored(spark, "A nice chronograph")
    assert silent.evidence.gates_failed == ["brand"]
    good = scored(spark, "TAG Heuer Carrera Chronograph 41mm", brand="TAG Heuer", attributes={"dial": "navy", "case material": "steel", "Movement Type": "self winding", "water_resistance": "30m"})
    assert good.confidence >= 85 and good.auto_accept and good.tier == "brand_spec_attributes"
    assert names(good.evidence.attribute_hits) == {"case_size", "dial_colour", "case_material", "movement"}
    worse = scored(spark, "TAG Heuer Carrera Chronograph 39mm", brand="TAG Heuer", attributes={"dial": "green"})
    assert {x.attribute for x in worse.evidence.attribute_misses if x.theirs != "(not published)"} == {"case_size", "dial_colour"} and worse.confidence < 50
    named = scored(spark, "TAG Heuer Carrera Chronograph 41mm", specs={}, category=None)
    assert named.tier == "fuzzy_name_specs" and named.confidence <= 80 and not named.auto_accept


def test_blank_attributes_do_not_hide_the_title(spark):
    got = scored(spark, "TAG Heuer Carrera Chronograph 41mm", brand="TAG Heuer", attributes={"case size": "  ", "dial": "blue"})
    assert {"case_size", "dial_colour"} <= names(got.evidence.attribute_hits)
    named = scored(spark, "TAG Heuer Carrera", brand=" ", attributes={"brand": "TAG Heuer", "dial": "blue"})
    assert named.viable


def test_discovery_opens_the_most_confident_and_tells_the_best_rejected(spark):
    schema = "product_id long, competitor_id long, url string, place int, mode string, result_title string, " + PAIR
    own = ("TAG Heuer", "Carrera Chronograph 41mm", "7612345678901", "watches", WATCH)
    good = {"dial": "blue", "case material": "steel", "movement": "automatic"}
    rows = [
        (1, 1, "a", 0, "search", "Omega Seamaster", *own, "TAG Heuer Carrera Chronograph 41mm", None, "TAG Heuer", good),  # its title is not viable
        (1, 1, "b", 1, "search", "TAG Heuer Carrera", *own, "TAG Heuer Carrera Chronograph 41mm", None, "TAG Heuer", good),
        (1, 1, "c", 2, "search", "TAG Heuer Carrera Chronograph 41mm", *own, "Omega", None, "Omega", None),
        (1, 1, "d", 3, "search", "TAG Heuer Carrera Chronograph 41mm", *own, "TAG Heuer Carrera 41mm", "999", "TAG Heuer", None),
        (1, 1, "e", 4, "search", "TAG Heuer Carrera", *own, "TAG Heuer Carrera Chronograph 41mm", None, "TAG Heuer", good),
        *[(2, 1, f"s{i}", i, "sitemap", None, *own, "TAG Heuer Carrera Chronograph 41mm" if i == 1 else "x", None, "TAG Heuer" if i < 3 else "Omega", good if i == 1 else None) for i in range(5)],
    ]
    stored, rejected = matching.discover(spark.createDataFrame(rows, schema))
    assert sorted((r.product_id, r.url) for r in stored.collect()) == [(1, "b"), (2, "s1")]
    told = {r.product_id: (r.url, r.reason) for r in rejected.collect()}
    assert told == {}  # either pair has a stored listing, so no rejected one is told
    one = stored.select(matching.evidence_json(F.col("evidence")).alias("j")).first().j
    assert set(json.loads(one)) == {"tier", "gatesPassed", "gatesFailed", "attributeHits", "attributeMisses", "nameSimilarity", "notes"}
    _, rejected = matching.discover(spark.createDataFrame([r for r in rows if r[2] in ("c", "d", "s0", "s3")], schema))
    told = {r.product_id: (r.url, r.reason) for r in rejected.collect()}
    assert told[1][0] == "c" and "brand" in told[1][1] and told[2][0] == "s0"


def test_pages_that_could_not_be_opened(spark):
    schema = "product_id long, competitor_id long, url string, place int, mode string, result_title string, readable boolean, " + PAIR
    own = ("TAG Heuer", "Carrera Chronograph 41mm", "7612345678901", "watches", WATCH)
    page = ("its page", "7612345678901", "TAG Heuer", {"dial": "blue"})
    rows = [(1, 1, "a", 0, "search", "TAG Heuer Carrera 41mm", False, *own, *page), (2, 1, "b", 0, "sitemap", None, False, *own, *page), (3, 1, "c", 0, "sitemap", None, None, *own, *page)]
    stored, rejected = matching.discover(spark.createDataFrame(rows, schema))
    got = {r.product_id: (r.title, r.tier) for r in stored.collect()}
    assert got == {1: ("TAG Heuer Carrera 41mm", "brand_spec_attributes"), 3: ("its page", "ean_mpn_exact")} and rejected.count() == 0


def test_scores_as_their_users_know_them(spark):
    alike = scored(spark, "Rolex Submariner", specs={}, ours=None, category=None, brand="Rolex", name="Submariner", of="Rolex")
    assert (alike.confidence, alike.tier, alike.evidence.name_similarity, alike.auto_accept) == (80, "fuzzy_name_specs", 1.0, False)
    assert alike.evidence.notes == ["No comparable spec attributes on the listing — fuzzy name match only."]
    wrong = scored(spark, "Omega Speedmaster 41mm Blue Dial Steel", ours=None, brand="Omega")
    assert (wrong.tier, wrong.viable, wrong.evidence.gates_failed, wrong.evidence.tier, wrong.evidence.attribute_hits, wrong.evidence.attribute_misses) == ("brand_spec_attributes", False, ["brand"], None, [], [])
    strong, weak = (scored(spark, "TAG Heuer Carrera Chronograph", ours=None, brand="TAG Heuer", attributes={"model": "Carrera", "case_size": s, "dial_colour": c, "case_material": "Steel"}) for s, c in (("41mm", "Blue"), ("44mm", "Black")))
    assert weak.confidence < strong.confidence and strong.confidence >= 85 and strong.evidence.gates_passed == ["brand", "model"]
    dry, wet = (scored(spark, "TAG Heuer Carrera Chronograph", ours=None, brand="TAG Heuer", attributes={"model": "Carrera", "case_size": "41mm", "water_resistance": w}) for w in ("100m", "300m"))
    assert dry.confidence == wet.confidence and wet.viable
    ring = {"metal_type": "Platinum", "centre_stone": "Diamond", "carat_weight": "0.50ct", "stone_cut": "Round", "ring_size": "L"}
    other = scored(spark, "Goldsmiths Platinum Round Diamond Solitaire Ring 0.50ct", ours=None, brand="Goldsmiths", specs=ring, attributes={**ring, "ring_size": "Q"}, category="rings", name="Solitaire Engagement Ring", of="Goldsmiths")
    assert other.viable and other.confidence >= 85 and "ring_size" not in names(other.evidence.attribute_hits) | names(other.evidence.attribute_misses)
    blank = scored(spark, "Goldsmiths Platinum Ring", ours=None, brand="Goldsmiths", specs=ring, attributes={"metal_type": "!!"}, category="rings", of="Goldsmiths")
    assert blank.evidence.gates_failed == ["metal_type"] and blank.evidence.gates_passed == ["brand"]
    silent = scored(spark, "TAG Heuer watch", ours="76", ean="-", brand="TAG Heuer")
    assert silent.evidence.notes == ["Competitor publishes EAN/MPN -, which differs from ours (76).", "Gate 'model' not published by competitor — treated as unknown.", "No comparable spec attributes on the listing — fuzzy name match only."] and silent.viable
    told = {x.attribute: (x.weight, x.ours, x.theirs) for x in (*good_evidence(spark).attribute_hits, *good_evidence(spark).attribute_misses)}
    assert told == {"dial_colour": ("high", "Blue", "(inferred from listing title)"), "case_size": ("high", "41mm", "39mm"), "case_material": ("high", "Stainless steel", "(not published)"), "movement": ("medium", "Automatic", "self winding")}


def good_evidence(spark):
    return scored(spark, "TAG Heuer Carrera blue 39", ours=None, brand="TAG Heuer", attributes={"case size": "39mm", "Movement Type": "self winding"}).evidence


def test_weights(spark):
    row = spark.range(1).select(*(matching.weight_of(F.lit("watch"), F.lit(a)).alias(a) for a in ("model", "case_size", "movement", "warranty", "taste"))).first()
    assert tuple(row) == ("gate", "high", "medium", "ignore", None)


def test_reasons(spark):
    rows = spark.createDataFrame([(0, ["brand"]), (0, ["metal_type"]), (12, [])], "c int, g array<string>")
    got = [r[0] for r in rows.select(matching.rejection_reason(F.col("c"), F.col("g"))).collect()]
    assert "brand" in got[0] and "metal type" in got[1] and "12%" in got[2]


def test_candidate_urls(spark):
    products = spark.createDataFrame([(1, ["daytona", "rolex"])], "product_id long, terms array<string>")
    urls = spark.createDataFrame([(7, f"u{i}", s) for i, s in enumerate(["rolex daytona", "rolex rolex", "rolex", "omega", "daytona x", "rolex y", "rolex z"])], "competitor_id long, url string, slug string")
    got = [(r.url, round(r["rank"], 2)) for r in matching.candidate_urls(products, urls).orderBy("place").collect()]
    assert got == [("u0", 2.0), ("u1", 1.25), ("u2", 1.0), ("u4", 1.0), ("u5", 1.0)]


def test_candidate_urls_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(14)]
    urls = [(c, f"u{i}" + "x" * rng.randint(0, 2), " ".join(rng.choice(vocabulary[: rng.choice([3, 14])]) for _ in range(rng.randint(0, 12)))) for c in (1, 2, 3) for i in range(60)]
    products = [(p, rng.sample([*vocabulary, "none"], rng.randint(0, 6))) for p in range(30)]
    want = set()
    for p, terms in products:
        for c in (1, 2, 3):
            ranked = []
            for k, u, slug in urls:
                rank = sum(sum(1 / (j * j) for j in range(1, slug.split().count(t) + 1)) for t in sorted(set(terms)))
                if k == c and rank:
                    ranked.append((-round(rank, 9), len(u), u))
            want |= {(p, c, u, i) for i, (_, _, u) in enumerate(sorted(ranked)[:5], 1)}
    got = matching.candidate_urls(spark.createDataFrame(products, "product_id long, terms array<string>"), spark.createDataFrame(urls, "competitor_id long, url string, slug string"))
    assert {(r.product_id, r.competitor_id, r.url, r.place) for r in got.collect()} == want


def test_addresses_of_very_many_words(spark):
    every = " ".join(f"w{i:03d}" for i in range(200))
    products = spark.createDataFrame([(i, [f"w{(i * 7 + k) % 200:03d}" for k in range(4)]) for i in range(40)], "product_id long, terms array<string>")
    urls = spark.createDataFrame([(1, f"https://x.co/{i}", every) for i in range(20)] + [(2, "https://x.co/z", "w001")], "competitor_id long, url string, slug string")
    got = matching.candidate_urls(products, urls).collect()
    assert sorted((r.product_id, r.place) for r in got if r.competitor_id == 1) == [(p, k) for p in range(40) for k in range(1, 6)]
    assert {r["rank"] for r in got if r.competitor_id == 1} == {4.0} and len(got) > 200
    none = matching.candidate_urls(products, urls.where("false"))
    assert none.columns == ["product_id", "competitor_id", "url", "rank", "place"] and none.count() == 0
    with pytest.raises(Exception, match="eight terms"):
        matching.candidate_urls(spark.createDataFrame([(1, [f"w{i:03d}" for i in range(9)])], products.schema), urls).collect()


FEED = "row_number long, id string, title string, price string, sale_price string, sale_price_effective_date string, price_visible string, brand string, gtin string, mpn string, availability string, product_type string, link string, metal_type string"
PRODUCTS = "id long, internal_sku string, brand string, product_name string, ean_mpn string, category string, our_product_url string, specs map<string,string>, currency string, source string, delisted_at timestamp, updated_at timestamp"
PRICES = "product_id long, fascia_id long, price double, regular_price double, on_sale boolean, currency string, feed_import_id long"


def now():
    return F.lit("2026-08-09 12:00:00").cast("timestamp")


def row(n, price="100.0 GBP", sale="", window="", visible="TRUE", **more):
    base = {"id": f"tst-{n}", "title": f"Ring {n}", "gtin": "7.32E+11", "mpn": f"M{n}", "brand": "", "availability": "", "metal": "gold"} | more
    return (n, base["id"], base["title"], price, sale, window, visible, base["brand"], base["gtin"], base["mpn"], base["availability"], "rings", None, base["metal"])


def test_authoritative_feed_step_by_step(spark):
    manual = (900, "tst-manual", "B", "Manual", None, None, None, {}, "GBP", "manual", None, None)
    state = {"products": spark.createDataFrame([manual], PRODUCTS), "prices": spark.createDataFrame([(900, 1, 50.0, None, False, "GBP", None)], PRICES)}

    def step(number, *rows):
        out = feed.run_import(state, spark.createDataFrame(list(rows), FEED), 1, number, now())
        for name in ("products", "prices"):
            state[name] = spark.createDataFrame(out[name].collect(), out[name].schema)
        prices = {r.product_id: r for r in state["prices"].collect()}
        products = {r.internal_sku: r for r in state["products"].collect()}
        return out["counters"].first(), products, {k: prices.get(p.id) for k, p in products.items()}

    c, p, _ = step(1, row(1), row(2), row(3), row(4, id=""), row(5, id="id"), row(6, title=""))
    assert (c.prices, c.skipped_blank, c.skipped_header, c.failed, c.damaged_gtin, c.with_identifier) == (3, 1, 1, 1, 3, 3)
    assert p["tst-1"].ean_mpn == "M1" and p["tst-1"].specs == {"metal_type": "gold"} and len(p) == 4
    ids = {k: x.id for k, x in p.items()}
    _, p, price = step(2, row(2, price="250 GBP"))
    assert {k for k, x in p.items() if x.delisted_at} == {"tst-1", "tst-3"} and price["tst-2"].price == 250 and price["tst-1"] is None
    assert {k: x.id for k, x in p.items()} == ids
    _, p, _ = step(3, row(1), row(2), row(3))
    assert not any(x.delisted_at for x in p.values())
    c, _, price = step(4, row(1, sale="80 GBP"), row(2), row(3))
    assert c.on_sale == 1 and (price["tst-1"].price, price["tst-1"].regular_price) == (80, 100)
    c, _, price = step(5, row(1, sale="80 GBP", window="2099-01-01T00:00Z/2099-02-01T00:00Z"), row(2), row(3))
    assert (c.on_sale, c.sale_not_yet_active) == (0, 1) and price["tst-1"].price == 100
    c, p, price = step(6, row(1, visible="false"), row(2), row(3), (9, *row(3)[1:3], "7 GBP", *row(3)[4:]))
    assert (c.price_hidden, c.prices) == (1, 3) and p["tst-1"].delisted_at and price["tst-3"].price == 7
    assert price["tst-manual"].price == 50 and p["tst-manual"].delisted_at is None


MATCH = "id long, product_id long, competitor_id long, url string, confidence int, tier string, status string, confirmed_by string, confirmed_at timestamp"


def test_match_decisions(spark):
    rows = [(1, 1, 1, "a", 90, "t", "confirmed", "kim", None), (2, 1, 1, "b", 50, "t", "pending", None, None), (3, 2, 1, "c", 50, "t", "rejected", None, None), (4, 3, 1, "d", 90, "t", "confirmed", "auto", None)]
    old = spark.createDataFrame(rows, MATCH)
    new = spark.createDataFrame([(1, 1, "a", 30, "n", "pending"), (1, 1, "b", 95, "n", "confirmed"), (2, 1, "c", 99, "n", "confirmed"), (3, 1, "d", 20, "n", "pending"), (4, 1, "e", 99, "n", "confirmed"), (4, 1, "f", 98, "n", "confirmed")], "product_id long, competitor_id long, url string, confidence int, tier string, status string")
    got = {r.url: (r.confidence, r.status, r.confirmed_by) for r in mutations.upsert_matches(old, new).collect()}
    assert got == {"a": (30, "confirmed", "kim"), "b": (95, "pending", None), "c": (99, "rejected", None), "d": (20, "pending", "auto"), "e": (99, "confirmed", "auto"), "f": (98, "pending", None)}
    two = spark.createDataFrame([(1, 5, 1, "A", 90, "t", "confirmed", "auto", None), (2, 6, 1, "r", 90, "t", "rejected", None, None)], MATCH)
    run = spark.createDataFrame([(5, 1, "A", 90, "n", "confirmed"), (5, 1, "B", 95, "n", "confirmed"), (6, 1, "r", 99, "n", "confirmed"), (6, 1, "s", 90, "n", "confirmed")], "product_id long, competitor_id long, url string, confidence int, tier string, status string")
    assert {r.url: r.status for r in mutations.upsert_matches(two, run).collect()} == {"A": "confirmed", "B": "pending", "r": "rejected", "s": "confirmed"}
    after = {r.id: (r.status, r.confirmed_by) for r in mutations.confirm_match(old, 2, "ana", now()).collect()}
    assert after[1] == ("rejected", "kim") and after[2] == ("confirmed", "ana") and after[4] == ("confirmed", "auto")
    assert {r.id: r.status for r in mutations.reject_match(old, 1).collect()}[1] == "rejected"
    with pytest.raises(ValueError):
        mutations.add_manual_match(old.drop("id", "confirmed_at"), 1, 1, "http://other", "https://x")
    assert mutations.add_manual_match(old.drop("id", "confirmed_at"), 9, 1, "https://x/1", "https://x").count() == 5


def test_manual_products_and_runs(spark):
    products = spark.createDataFrame([(3, "Abc", "feed")], "id long, internal_sku string, source string")
    prices = spark.createDataFrame([], "product_id long, fascia_id long, price double, currency string")
    with pytest.raises(ValueError):
        mutations.add_manual_product(products, prices, "ABC", "b", "n")
    with pytest.raises(ValueError):
        mutations.add_manual_product(products, prices, "x", "b", "n", price=-1, fascia_id=1)
    known = products.withColumns({"brand": F.lit("q"), "product_name": F.lit("r"), "ean_mpn": F.lit(None).cast("string"), "specs": F.create_map().cast("map<string,string>")})
    got, priced = mutations.add_manual_product(known, prices, "x", "b", "n", price=1, fascia_id=2, identifier=" 9 ", reference="R1")
    assert sorted((r.id, r.internal_sku, r.source, r.ean_mpn, r.specs) for r in got.collect()) == [(3, "Abc", "feed", None, {}), (4, "x", "manual", "9", {"reference_number": "R1"})]
    assert [tuple(r) for r in priced.collect()] == [(4, 2, 1.0, "GBP")]
    assert mutations.add_manual_product(known, prices, "y", "b", "n")[1].count() == 0
    at = lambda h: dt.datetime(2026, 1, 1, h)
    events = spark.createDataFrame([(1, "started", at(1)), (1, "failed", at(2)), (2, "started", at(3))], "run_id long, event string, at timestamp")
    assert {r.run_id: (r.status, r.finished_at) for r in mutations.run_states(events).collect()} == {1: ("failed", at(2)), 2: ("running", None)}


def test_unknown_modes_are_refused(spark):
    runs = spark.createDataFrame([(4, "completed")], "id long, status string")
    got = mutations.start_run(runs, "prices", now(), product_id=7).orderBy("id").collect()
    assert [(r.id, r.status) for r in got] == [(4, "completed"), (5, "running")] and got[1].product_id == 7
    with pytest.raises(ValueError):
        mutations.start_run(runs, "all", now())


def test_import_errors_have_a_limit(spark):
    rows = spark.createDataFrame([(i, f"s{i}", "" if i % 2 else "t", "none") for i in range(500)], "row_number long, id string, title string, price string")
    got = feed.import_errors(rows).collect()
    assert len(got) == 200 and tuple(got[0]) == (0, "s0", 'price "none" could not be read') and got[1].error == "title is missing"

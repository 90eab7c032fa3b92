"""Candidate addresses of products, and scores of candidate listings with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import rules, text
from pricelake.sources.shared import workspace


#: The most terms of a question; search terms are eight at most.
TERMS_MOST = 8


def _subsets(terms: Column) -> Column:
    """All non-empty subsets of an array, in its order."""
    numbers = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(terms)) - 1)
    return F.transform(numbers, lambda m: F.filter(terms, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _asked_sets(whole: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """The best addresses of a shop for each set of words that is asked for: (competitor_id, part, top), top: (-rank, length, url) in order.

    whole: (competitor_id, url, words), words with their weights in order; parts:
    (part, size), sets as texts.  Sets grow word by word, and only those that some
    question asks for grow further, so an address is listed once for each set that
    it shares with a question, however many words it has and however many
    addresses share them.  Each step is written, so that the next reads it.
    """
    spark, place = whole.sparkSession, workspace(whole.sparkSession, "asked-sets")
    parts = _written(parts, f"{place}/parts")
    one = whole.select("competitor_id", "url", "words", F.posexplode("words").alias("at", "word"))
    level = one.select("competitor_id", "url", "words", "at", F.col("word.term").alias("part"), F.col("word.weight").alias("total"))
    best = None
    for size in range(1, TERMS_MOST + 1):
        kept = _written(level.join(parts.where(F.col("size") == size).select("part"), "part", "left_semi"), f"{place}/{size}")
        if kept.isEmpty():
            break
        rows = kept.select("competitor_id", "part", (-F.col("total")).alias("rank"), F.length("url").alias("n"), "url")
        best = rows if best is None else best.union(rows)
        more = kept.select("competitor_id", "url", "words", "part", "total", F.posexplode("words").alias("next", "word"), "at").where(F.col("next") > F.col("at"))
        level = more.select("competitor_id", "url", "words", F.col("next").alias("at"), F.concat("part", F.lit(" "), "word.term").alias("part"), (F.col("total") + F.col("word.weight")).alias("total"))
    if best is None:
        return spark.createDataFrame([], f"competitor_id {whole.schema['competitor_id'].dataType.simpleString()}, part string, top array<struct<rank:double,n:int,url:string>>")
    first = Window.partitionBy("competitor_id", "part").orderBy("rank", "n", "url")
    best = best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    return best.groupBy("competitor_id", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "url"))).alias("top"))


def candidate_urls(products: DataFrame, urls: DataFrame, most: int = 5) -> DataFrame:
    """For each product and competitor the addresses that share most with the product's search terms.

    products: (product_id, terms array, of at most eight); urls: (competitor_id,
    url, slug).  An address's rank is the sum over terms of 1 + 1/4 + ... + 1/n^2
    for its n occurrences; of equals the shorter, then the lesser address comes
    first.  Products without a term that any address has, and shops without an
    address that has one, give no rows; an address listed twice counts its words
    twice.

    Products with the same terms among the addresses' words are one question.  For
    each set of words that a question asks for, a shop's best addresses with those
    words are kept; a question looks up the sets within its terms: whoever is among
    the best for all terms is among the best of the set that it shares with them.
    A word that most addresses have costs no more than others.  Terms and questions
    are as many as products, though their files are small: they are joined by
    shuffles, never sent to the driver.
    """
    words = urls.select("competitor_id", "url", F.explode(F.split("slug", " ")).alias("term")).where("term != ''")
    terms = products.select("product_id", F.explode("terms").alias("term")).distinct()
    weight = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    words = words.join(terms.select("term").distinct().hint("merge"), "term").groupBy("competitor_id", "url", "term").agg(F.count("*").alias("n"))
    words = words.select("competitor_id", "url", F.struct("term", weight.alias("weight")).alias("word"))
    place = workspace(products.sparkSession, "candidates")
    whole = _written(words.groupBy("competitor_id", "url").agg(F.sort_array(F.collect_list("word")).alias("words")), f"{place}/addresses")

    known = terms.join(whole.select(F.explode("words.term").alias("term")).distinct().hint("merge"), "term")
    asked = known.groupBy("product_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    asked = asked.select("product_id", F.when(F.size("terms") <= TERMS_MOST, F.col("terms")).otherwise(F.raise_error(F.lit("a question has more than eight terms"))).alias("terms"))
    asked = _written(asked, f"{place}/asked")
    question = F.array_join("terms", " ").alias("question")
    sets = asked.select("terms").distinct().select(question, F.explode(_subsets(F.col("terms"))).alias("part"))
    sets = sets.select("question", F.array_join("part", " ").alias("part"), F.size("part").alias("size"))
    listed = _asked_sets(whole, sets.select("part", "size").distinct(), most)

    # Of the lists of a question's sets, at most 5 * 2^8 addresses, the first place of each address has its whole rank.
    hits = sets.join(listed, "part").groupBy("question", "competitor_id").agg(F.array_sort(F.flatten(F.collect_list("top"))).alias("all"))
    hits = hits.withColumn("urls", F.col("all.url"))
    first = F.transform(F.slice(F.array_distinct("urls"), 1, most), lambda u: F.get("all", (F.array_position("urls", u) - 1).cast("int")))
    best = hits.select("question", "competitor_id", F.posexplode(first).alias("place", "best"))
    best = best.select("question", "competitor_id", F.col("best.url").alias("url"), (-F.col("best.rank")).alias("rank"), (F.col("place") + 1).alias("place"))
    return asked.select("product_id", question).join(best.hint("merge"), "question").select("product_id", "competitor_id", "url", "rank", "place")


def _of_category(category: Column, made) -> Column:
    """What made(gate, high, medium, ignore) gives for the rule set of a category."""
    return F.coalesce(*[F.when(category == name, made(*lists)) for name, (_, *lists) in rules.CATEGORIES.items()])


def weight_of(category: Column, attribute: Column) -> Column:
    """gate, high, medium or ignore: what an attribute weighs in a rule set; null where that doesn't know it."""
    weights = lambda *lists: F.create_map(*[F.lit(x) for w, some in zip(("gate", "high", "medium", "ignore"), lists, strict=True) for a in some for x in (a, w)])
    return F.try_element_at(_of_category(category, weights), attribute)


def _listed_specs(df: DataFrame) -> DataFrame:
    """Adds _ours and _theirs: arrays of (k, v), each name once; what a listing doesn't publish is inferred from its title."""
    last = lambda entries: F.transform(F.array_distinct(F.transform(entries, lambda e: e["k"])), lambda k: F.struct(k.alias("k"), text.spec_value(entries, k).alias("v")))
    said = lambda name, value: F.filter(F.array(F.struct(F.lit(name).alias("k"), value.alias("v"))), lambda e: F.trim(e["v"]) != "")
    none = F.array().cast("array<struct<k:string,v:string>>")
    title = F.coalesce("title", F.lit(""))
    # A product's brand counts but where its attributes name another; a listing's attributes count before what is inferred.
    df = df.withColumns({
        "_ours": last(F.concat(said("brand", F.col("brand")), F.coalesce(text.canonical_specs(F.col("specs")), none))),
        "_theirs": F.coalesce(text.canonical_specs(F.col("attributes")), none),
    })
    inferred = F.concat(said("brand", F.col("listing_brand")), said("case_size", F.regexp_extract(title, rules.SIZE_MM, 1)), said("carat_weight", F.regexp_extract(title, rules.CARAT, 0)))
    unit = lambda e: F.when(e["k"] == "case_size", F.concat(e["v"], F.lit("mm"))).otherwise(e["v"])
    return df.withColumn("_theirs", last(F.concat(F.transform(inferred, lambda e: F.struct(e["k"].alias("k"), unit(e).alias("v"))), "_theirs")))


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Adds confidence, tier, viable, auto_accept and the evidence to pairs of a product and a listing.

    Columns read: brand, product_name, ean_mpn, category, specs (map) of the
    product; title, listing_ean, listing_brand, attributes (map) of the listing.
    Equal identifiers decide for, different ones against; then gates, in the
    order of the category's rules, the first that fails against; then weighted
    attributes and the likeness of brand and name with the title.  evidence: tier
    (null where rejected), gates_passed, gates_failed, attribute_hits and
    attribute_misses (attribute, weight, ours, theirs), name_similarity, notes.
    """
    ours_id, theirs_id = text.normalise_identifier(F.col("ean_mpn")), text.normalise_identifier(F.col("listing_ean"))
    title = F.coalesce("title", F.lit(""))
    df = _listed_specs(pairs).withColumn("_rules", text.category_of(F.col("category")))
    df = df.withColumn("_hay", text.normalise_text(F.concat_ws(" ", title, F.array_join(F.transform("_theirs", lambda e: e["v"]), " "))))

    # The gates that we can ask for, in the rules' order, then the weighted attributes that we have.
    names = F.transform("_ours", lambda e: e["k"])
    gates = _of_category(F.col("_rules"), lambda gate, *_: F.array(*map(F.lit, gate)))
    asked = F.concat(F.filter(gates, lambda g: F.array_contains(names, g)), F.filter(names, lambda k: weight_of(F.col("_rules"), k).isin("high", "medium")))
    with_values = lambda k: F.struct(k.alias("attribute"), weight_of(F.col("_rules"), k).alias("weight"), text.spec_value(F.col("_ours"), k).alias("ours"), text.spec_value(F.col("_theirs"), k).alias("theirs"))
    df = df.withColumn("_seen", F.transform(asked, with_values))
    # Both values are normalised by one expression, which is a long one.
    both = lambda x: F.transform(F.array(x["ours"], x["theirs"]), lambda v: text.normalise_attribute(x["attribute"], v))
    df = df.withColumn("_seen", F.transform("_seen", lambda x: F.struct(x["attribute"].alias("attribute"), x["weight"].alias("weight"), x["ours"].alias("ours"), x["theirs"].alias("theirs"), both(x).alias("both"))))
    df = df.withColumn("_seen", F.filter("_seen", lambda x: F.get(x["both"], F.lit(0)).isNotNull()))

    def verdict(x: Column) -> Column:
        mine, other, gate = F.get(x["both"], F.lit(0)), F.get(x["both"], F.lit(1)), x["weight"] == "gate"
        agrees = F.when(gate, other.contains(mine) | mine.contains(other)).otherwise(mine == other)
        # A gate that is published, but says nothing once normalised, fails.
        against = F.when(gate, x["theirs"].isNotNull()).otherwise(other.isNotNull())
        said = F.when(agrees, "hit").when(against, "miss").when(text.text_supports(F.col("_hay"), x["attribute"], mine), "text").otherwise("unknown")
        return F.struct(x["attribute"].alias("attribute"), x["weight"].alias("weight"), x["ours"].alias("ours"), x["theirs"].alias("theirs"), said.alias("verdict"))

    df = df.withColumn("_seen", F.transform("_seen", verdict))
    is_gate = lambda x: x["weight"] == "gate"
    fails = lambda x: (x["verdict"] == "miss") | ((x["verdict"] == "unknown") & (x["attribute"] == "brand"))
    df = df.withColumns({"_gates": F.filter("_seen", is_gate), "_weighted": F.filter("_seen", lambda x: ~is_gate(x))})
    df = df.withColumn("_stop", F.array_position(F.transform("_gates", fails), F.lit(True)))
    points = lambda x: F.when(x["weight"] == "high", F.lit(rules.HIGH_POINTS)).otherwise(F.lit(rules.MEDIUM_POINTS))
    gained = lambda x: points(x) * F.when(x["verdict"] == "hit", 1.0).when(x["verdict"] == "text", rules.TEXT_SHARE).otherwise(0.0)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    df = df.withColumns({
        "_earned": total("_weighted", gained), "_available": total(F.filter("_weighted", lambda x: x["verdict"] != "unknown"), points),
        "_same": text.name_similarity(F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), F.coalesce("product_name", F.lit(""))), title),
    })
    half_up = lambda x: F.floor(x + F.lit(0.5))
    by_specs = half_up(F.try_divide("_earned", "_available") * 100 * 0.8 + F.col("_same") * 100 * 0.2)
    by_name = half_up(F.least(F.col("_same") * 100, F.lit(float(rules.AUTO_ACCEPT - 5))))

    published = (F.coalesce("ean_mpn", F.lit("")) != "") & (F.coalesce("listing_ean", F.lit("")) != "")
    exact = published & (ours_id != "") & (ours_id == theirs_id)
    conflict = published & (ours_id != "") & (theirs_id != "") & (ours_id != theirs_id)
    gated = F.col("_stop") > 0
    weighed = ~exact & ~conflict & ~gated
    specified = F.col("_available") > 0
    confidence = F.when(exact, 100).when(~weighed, 0).when(specified, by_specs).otherwise(by_name)
    df = df.withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), confidence)).cast("int"))
    tier = F.when(exact, "ean_mpn_exact").when(~weighed | specified, "brand_spec_attributes").otherwise("fuzzy_name_specs")

    # What was looked at before the verdict fell: the gates up to the one that failed, the attributes only where all passed.
    looked = F.when(exact | conflict, F.slice("_gates", 1, 0)).when(gated, F.slice("_gates", F.lit(1), F.greatest(F.col("_stop").cast("int") - 1, F.lit(0)))).otherwise(F.col("_gates"))
    passed = F.transform(F.filter(looked, lambda x: x["verdict"].isin("hit", "text")), lambda x: x["attribute"])
    failed = F.when(conflict, F.array(F.lit("ean_mpn"))).when(gated & ~exact, F.array(F.get(F.col("_gates"), F.col("_stop").cast("int") - 1)["attribute"])).otherwise(F.array().cast("array<string>"))
    weighted = F.when(weighed, F.col("_weighted")).otherwise(F.slice("_weighted", 1, 0))
    theirs = lambda x: F.when(x["verdict"] == "text", rules.INFERRED).when(x["verdict"] == "unknown", rules.NOT_PUBLISHED).otherwise(x["theirs"])
    told = lambda xs, *kinds: F.transform(F.filter(xs, lambda x: x["verdict"].isin(*kinds)), lambda x: F.struct(x["attribute"].alias("attribute"), x["weight"].alias("weight"), x["ours"].alias("ours"), theirs(x).alias("theirs")))
    note = lambda condition, pattern, *args: F.when(condition, F.array(F.format_string(pattern, *args))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(
        note(exact, rules.NOTE_EXACT, F.col("ean_mpn")),
        note(published & ~exact, rules.NOTE_DIFFERS, F.col("listing_ean"), F.col("ean_mpn")),
        F.transform(F.filter(looked, lambda x: x["verdict"] == "unknown"), lambda x: F.format_string(rules.NOTE_GATE, x["attribute"])),
        note(weighed & ~specified, rules.NOTE_FUZZY),
    )
    evidence = F.struct(
        F.when(exact | weighed, tier).alias("tier"),
        passed.alias("gates_passed"),
        failed.alias("gates_failed"),
        told(weighted, "hit", "text").alias("attribute_hits"),
        told(weighted, "miss", "unknown").alias("attribute_misses"),
        F.when(weighed, F.round("_same", 3)).alias("name_similarity"),
        notes.alias("notes"),
    )
    df = df.withColumns({"tier": tier, "evidence": evidence, "viable": exact | (weighed & (F.col("confidence") >= rules.MIN_CANDIDATE))})
    df = df.withColumn("auto_accept", F.col("viable") & (F.col("confidence") >= rules.AUTO_ACCEPT))
    return df.drop("_hay", "_ours", "_theirs", "_rules", "_seen", "_gates", "_weighted", "_stop", "_earned", "_available", "_same")


def rejection_reason(confidence: Column, gates_failed: Column) -> Column:
    """Why a listing was not stored, as a sentence."""
    gate = F.get(gates_failed, F.lit(0))
    return (
        F.when(gate == "brand", "the brand of the listing is not known to be ours")
        .when(gate == "ean_mpn", "the listing's EAN/MPN differs from ours")
        .when(gate.isNotNull(), F.format_string("its %s does not agree with ours", F.replace(gate, F.lit("_"), F.lit(" "))))
        .otherwise(F.format_string(f"its confidence of %d%% is below the {rules.MIN_CANDIDATE}%% needed", confidence))
    )


def discover(candidates: DataFrame, opened: int = 3) -> tuple[DataFrame, DataFrame]:
    """(stored, best rejected) of candidates: (product_id, competitor_id, url, place, mode, ...) with the columns of score_candidates.

    mode: "search" or "sitemap".  A first score goes by the title that the search
    told (result_title; none in a sitemap); of a search's results only viable ones
    count on.  Of each product and competitor the most confident are opened, of
    equals the first.  A boolean column readable (null, or none: true) tells
    whether a page could be opened: one that couldn't is judged by its search
    result alone, and is passed over where a sitemap named it.  Viable listings
    are stored; where a pair has none, the most confident of the others, of equals
    the first opened, is told.
    """
    key = ["product_id", "competitor_id", "url", "place"]
    page = {"listing_ean": "string", "listing_brand": "string", "attributes": "map<string,string>"}
    if "readable" not in candidates.columns:
        candidates = candidates.withColumn("readable", F.lit(True))
    candidates = candidates.withColumn("readable", F.coalesce("readable", F.lit(True)))
    alone = candidates.withColumns({c: F.lit(None).cast(kind) for c, kind in page.items()}).withColumn("title", F.col("result_title"))
    first = score_candidates(alone).where((F.col("mode") == "sitemap") | F.col("viable"))
    order = Window.partitionBy("product_id", "competitor_id").orderBy(F.desc("confidence"), "place")
    chosen = first.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= opened).select(*key, "turn")
    seen = candidates.join(chosen, key).where(F.col("readable") | (F.col("mode") == "search"))
    known = {c: F.when(F.col("readable"), F.col(c)) for c in page}
    scored = score_candidates(seen.withColumns(known | {"title": F.coalesce(F.when(F.col("readable"), F.col("title")), "result_title")}))
    best = Window.partitionBy("product_id", "competitor_id").orderBy(F.col("viable").desc(), F.desc("confidence"), "turn")
    rest = scored.withColumn("rn", F.row_number().over(best)).where("rn = 1 AND NOT viable").drop("rn")
    return scored.where("viable"), rest.withColumn("reason", rejection_reason(F.col("confidence"), F.col("evidence.gates_failed")))


def evidence_json(evidence: Column) -> Column:
    """The evidence of a score as it is stored: JSON under its users' names, without what is null."""
    return F.to_json(F.struct(*(evidence[c].alias(name) for c, name in rules.EVIDENCE_NAMES.items())))

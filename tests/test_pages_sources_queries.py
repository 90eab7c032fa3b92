import json
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pricelake.operators import comparison, pages, reports
from pricelake.plans.catalogue import ORACLES, QUERIES
from pricelake.sources import competitors, tabular
from pricelake.streaming.observations import append_batch, append_items, append_observations, hourly_prices

SF = "/root/testdata/sf0.001"
SELECTORS = {"selectors": {"title": [".name"], "price": [".price-now"], "wasPrice": [".price-was"], "availability": [".stock"], "promoBadge": [".badge"]}}


def listing(spark, html, config=SELECTORS):
    return pages.extract_listings(spark.createDataFrame([(html,)], "html string"), config).first().listing


def test_listing_from_linked_data(spark):
    data = {"@graph": [{"@type": ["Product"], "name": " Carrera ", "gtin13": "761", "brand": {"name": "TAG"}, "color": "Blue", "additionalProperty": [{"name": "Case Diameter", "value": "41mm"}], "offers": {"@type": "Offer", "price": 4250, "priceCurrency": "GBP", "availability": "https://schema.org/InStock"}}]}
    got = listing(spark, f'<script type="application/ld+json">not json</script><script type="application/ld+json">{json.dumps(data)}</script><div class="price-was">£5,000.00</div><dl><dt>Strap</dt><dd>Leather</dd></dl>')
    assert (got.title, got.price, got.was_price, got.promo, got.in_stock, got.ean, got.brand, got.source, got.error_kind) == ("Carrera", 4250.0, 5000.0, True, True, "761", "TAG", "json-ld", None)
    assert got.attributes == {"dial_colour": "Blue", "case_size": "41mm", "strap_material": "Leather"}


def test_listing_from_selectors_and_faults(spark):
    got = listing(spark, '<h1>Ring <b>A</b></h1><p class="price-now big">£1,200.50</p><p class="stock">Sold out</p><table><tr><th>Metal</th><td>Gold</td></tr><tr><td>x</td></tr></table>')
    assert (got.title, got.price, got.in_stock, got.source, got.promo) == ("Ring A", 1200.5, False, "selector", False) and got.attributes == {"metal_type": "Gold"}
    assert listing(spark, "<h1>x</h1>").error_kind == "no_price_found"
    assert listing(spark, '<p class="price-now">£0.00</p>').error_kind == "implausible_price"
    assert listing(spark, "<h1>x</h1>", {"sanityContains": [".product"]}).error_kind == "layout_changed"
    assert listing(spark, None).error_kind == "no_price_found"
    assert listing(spark, '<div itemprop="price" content="12"></div>', {"selectors": {"price": ["div[itemprop=price]"]}}).price == 12.0


def test_pages_that_nobody_closed(spark):
    deep = "<ul>" + "<li>a" * 3000 + "<div>" * 3000 + '<p class="price-now">£5'
    assert listing(spark, deep).price == 5.0
    odd = '<script type="application/ld+json">{"@type":"Product","name":"N","additionalProperty":5,"offers":{"@type":"Offer","price":7}}</script>'
    assert (listing(spark, odd).title, listing(spark, odd).price) == ("N", 7.0)
    assert listing(spark, '<script type="application/ld+json">' + "[" * 100_000 + "</script>").error_kind == "no_price_found"
    assert listing(spark, "<dl><dt>Metal<dd>Gold<dt>Size<dd>M</dl><table><tr><td>Cut<td>Round<tr><th>x</table>").attributes == {"metal_type": "Gold", "size": "M", "stone_cut": "Round"}
    found = pages.parse_html('<div class="a b"><p id=x data-k="v w">1<p>2</div><p>3</p>')
    assert [n.text() for n in found.select("div.a.b p")] == ["1", "2"] and len(found.select("p, div")) == 4
    assert len(found.select("#x[data-k*=w]")) == 1 and not found.select("p > p, [!]") and len(found.select("*")) == 4


def test_sitemap_files_walk_and_survey(spark):
    import gzip

    packed = gzip.compress(b"<urlset><url><loc>https://x.co/z</loc></url></urlset>")
    files = spark.createDataFrame([(1, "a", bytearray(packed)), (1, "b", bytearray(b"\x1f\x8bbroken")), (1, "c", bytearray(b"<urlset></urlset>")), (1, "d", None)], "competitor_id long, file string, content binary")
    got = {r.file: (r.body, r.error) for r in pages.sitemap_bodies(files).collect()}
    assert "z" in got["a"][0] and got["b"][0] is None and got["b"][1] and got["c"] == ("<urlset></urlset>", None) and got["d"][1]
    index = lambda *x: "".join(f"<sitemap><loc>{y}</loc></sitemap>" for y in x)
    bodies = [(1, "root", index("m1", "m2", "root")), (1, "m1", "<url><loc>u1</loc><lastmod>2026-01-01</lastmod></url><url><loc>u2</loc></url>"), (1, "m2", "<url><loc>u1</loc><lastmod>2025-01-01</lastmod></url>" + index("m3")), (1, "m3", "<url><loc>u3</loc></url>"), (1, "loose", "<url><loc>no</loc></url>"), (2, "r2", "")]
    entries = pages.sitemap_entries(spark.createDataFrame(bodies, "competitor_id long, file string, body string"))
    roots = spark.createDataFrame([(1, "root"), (2, "r2")], "competitor_id long, file string")
    walk = pages.walked(entries, roots)
    assert {(r.competitor_id, r.file, r.turn) for r in walk.collect()} == {(1, "root", 1), (1, "m1", 2), (1, "m2", 3), (1, "m3", 4), (2, "r2", 1)}
    assert {r.file for r in pages.walked(entries, roots, 2).where("competitor_id = 1").collect()} == {"root", "m1"}
    urls = {r.url: str(r.lastmod)[:10] for r in pages.harvest(entries.join(walk, ["competitor_id", "file"])).collect()}
    assert urls == {"u1": "2026-01-01", "u2": "None", "u3": "None"}
    known = spark.createDataFrame([(1, None), (2, None), (3, "robots.txt: 503")], "competitor_id long, error string")
    told = spark.createDataFrame([(1, "root", None), (1, "m1", None), (1, "m2", "HTTP 500"), (1, "m3", None), (2, "r2", None)], "competitor_id long, file string, error string")
    looked = pages.survey(known, roots, told, entries, children=2, samples=1).withColumn("verdict", pages.sitemap_verdict(*[F.col(c) for c in ("error", "total_urls", "indexes", "failed", "declared")]))
    rows = {r.competitor_id: (r.declared, r.read, r.failed, r.indexes, r.total_urls, r.sample, r.first_fault, r.verdict) for r in looked.collect()}
    assert rows[1] == (1, 2, 1, 1, 3, ["u1"], "HTTP 500", "Usable")
    assert rows[2][-1] == "Empty" and rows[3][-1] == "Blocked at robots.txt"
    assert tuple(pages.survey_summary(looked).first()) == (1, 2, 2)


def test_robots_of_a_path(spark):
    body = "User-agent: *\nDisallow: /all\nUser-agent: Pricemonitor\nDisallow: /a\nAllow: /a/b$\n"
    asked = ["/a/c", "/a/b", "/a/bc", "/all", "/", "/x?a=/a"]
    groups = pages.robots_groups(spark.createDataFrame([(1, body), (2, "")], "site int, body string"), "PriceMonitorBot")
    urls = spark.createDataFrame([(1, f"https://x.co{p}") for p in asked] + [(2, "https://y.co")], "site int, url string")
    got = {r.url: r.disallowed for r in pages.robots_probe(urls, groups).collect()}
    assert got == {"https://x.co/a/c": True, "https://x.co/a/b": False, "https://x.co/a/bc": True, "https://x.co/all": True, "https://x.co/": False, "https://x.co/x?a=/a": False, "https://y.co": False}
    seen = pages.inspect_robots(spark.createDataFrame([(1, 200, body), (2, 404, None), (3, 503, None)], "site int, status int, body string"), spark.createDataFrame([(1, "https://x.co/a"), (2, "https://y.co/a"), (3, "https://z.co/a")], "site int, url string"), "PriceMonitorBot")
    assert {r.site: (r.state, r.allowed) for r in seen.collect()} == {1: ("ok", False), 2: ("absent", True), 3: ("unreachable", False)}
    assert tuple(pages.robots_summary(seen).first()) == (1, 2, 1)


def test_robots_rules_fit_as_globs_do(spark):
    import random
    import re
    import time

    rng = random.Random(2)
    rows = [("".join(rng.choice("/ab.") for _ in range(rng.randint(0, 9))), "".join(rng.choice("/ab*.$") for _ in range(rng.randint(1, 6)))) for _ in range(3000)]
    rows += [("/a", "/a$"), ("/ab", "/a$"), ("/a", "$"), ("/aXa", "/a*a$"), ("/a", "/a*a$"), ("/a$b", "/a$b"), ("/a", "*$"), ("/a(b", "/a(b"), ("/é/x", "/é*x$")]

    def want(path, rule):
        whole = rule.endswith("$")
        body = "".join(".*" if c == "*" else re.escape(c) for c in (rule[:-1] if whole else rule))
        return re.match(body + ("$" if whole else ""), path) is not None

    df = spark.createDataFrame(rows, "path string, rule string")
    got = [r.fits for r in df.select(pages.rule_fits(F.col("path"), F.col("rule")).alias("fits")).collect()]
    assert got == [want(*r) for r in rows] and 100 < sum(got) < 2900
    hostile = spark.createDataFrame([("a" * 5000, "*".join("a" * 14) + "*b"), ("a" * 60, "*a" * 30 + "$")], "path string, rule string")
    begun = time.time()
    assert [r.f for r in hostile.select(pages.rule_fits(F.col("path"), F.col("rule")).alias("f")).collect()] == [False, True]
    assert time.time() - begun < 20


def test_many_rules_are_looked_up_by_their_beginnings(spark):
    groups = spark.range(10_000).select(F.length(F.repeat(F.lit("x"), (F.col("id") % 1 + 1).cast("int"))).alias("site"), (F.col("id") % 2 == 0).alias("allow"), F.format_string("/p%05d*x", "id").alias("rule"))
    urls = spark.range(2_000).select(F.length(F.repeat(F.lit("x"), (F.col("id") % 1 + 1).cast("int"))).alias("site"), F.format_string("https://x.co/p%05d/x", "id").alias("url"))
    got = pages.robots_probe(urls, groups)
    assert got.where("disallowed").count() == 1_000
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_search_icons_sitemap_robots(spark):
    html = '<div class="tile"><a href="/a">First</a><b class="p">£10.00</b></div><div class="tile"><a href="/a">Again</a></div><div class="tile"><a href="b" title="T"></a></div>'
    found = pages.search_results(spark.createDataFrame([(html,)], "html string"), {"resultItem": [".tile"], "resultPrice": [".p"]}, "https://x.co/s/").orderBy("place").collect()
    assert [(r.url, r.title, r.price) for r in found] == [("https://x.co/a", "First£10.00", 10.0), ("https://x.co/s/b", "T", None)]
    icons = '<link rel="icon" sizes="16x16" href="/s.png"><link rel="icon" sizes="64x64" href="/l.png"><link rel="apple-touch-icon" href="//cdn.co/t.png"><link rel="icon" href="data:x">'
    got = pages.icon_urls(spark.createDataFrame([(icons, "https://x.co/p")], "html string, url string")).first().icons
    assert got == ["https://cdn.co/t.png", "https://x.co/l.png", "https://x.co/s.png", "https://x.co/favicon.ico"]
    xml = "<sitemapindex><sitemap><loc>https://x.co/1.xml</loc></sitemap></sitemapindex><urlset><url><loc> https://x.co/a?b=1&amp;c=2 </loc><lastmod>2026-01-01</lastmod></url><url></url></urlset>"
    entries = pages.sitemap_entries(spark.createDataFrame([(7, xml)], "competitor_id long, body string"))
    assert [(r.kind, r["loc"], r.lastmod) for r in entries.collect()] == [("sitemap", "https://x.co/1.xml", None), ("url", "https://x.co/a?b=1&c=2", "2026-01-01")]
    assert pages.harvest(entries.union(entries)).select("slug").collect()[0].slug == "a"
    robots = "User-agent: PriceMonitorBot\nUser-agent: other\nDisallow: /no\nUser-agent: *\nDisallow: /a # x\nDisallow: /a\nAllow: /b\nDisallow:\n"
    rules = pages.robots_rules(spark.createDataFrame([(1, robots), (2, "User-agent:\r\nDisallow: /all")], "site int, body string"), "PriceMonitorBot/0.1")
    assert sorted((r.site, r.rule) for r in rules.collect()) == [(1, "/a"), (2, "/all")]
    ok = spark.createDataFrame([(404, True), (500, False), (None, False), (200, True), (200, None)], "s int, d boolean").select(pages.allowed(F.col("s"), F.col("d")))
    assert [r[0] for r in ok.collect()] == [True, False, False, False, True]


def test_tabular_sources(spark, tmp_path):
    (tmp_path / "f.tsv").write_text('﻿id\ttitle\n 1 \t"a ""b"""\n\t\n2\n')
    rows = tabular.read_delimited(spark, str(tmp_path / "f.tsv")).orderBy("row_number").collect()
    assert [(r.id, r.title) for r in rows] == [("1", 'a "b"'), ("2", "")]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>ti</t></r><r><t>tle</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row/><row><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    got = tabular.read_workbooks(spark, str(tmp_path / "w.xlsx")).collect()
    assert [(r.row_number, r["values"]) for r in got] == [(3, {"id": "", "title": "5"})]
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet r:id="r2"/><sheet r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></R>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>day</t></is></c><c r="B1" t="str"><f>x</f><v>sum</v></c></row><row><c r="A2" s="1"><v>45000.5</v></c><c r="B2" s="0"><v>3</v></c></row><row><c r="A3" s="2"><v>45001</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert [r["values"] for r in tabular.read_workbooks(spark, str(tmp_path / "d.xlsx")).orderBy("row_number").collect()] == [{"day": "2023-03-15T12:00:00.000Z", "sum": "3"}, {"day": "2023-03-16T00:00:00.000Z", "sum": "true"}]
    assert [(r.row_number, r["values"]["title"]) for r in tabular.read_table(spark, str(tmp_path / "f.tsv")).orderBy("row_number").collect()] == [(2, 'a "b"'), (4, "")]
    (tmp_path / "t.csv").write_text("id,x,x,\n1,a,b,c\n\n2\n")
    assert [(r.id, r.x, r.row_number) for r in tabular.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", "b", 2), ("2", "", 3)]
    (tmp_path / "t.csv").unlink()
    for name, body in (("old.xls", bytes.fromhex("D0CF11E0A1B11AE1")), ("web.xls", b"<html>"), ("x.pdf", b"a")):
        (tmp_path / name).write_bytes(body)
        with pytest.raises(ValueError):
            tabular.read_table(spark, str(tmp_path / name))
        (tmp_path / name).unlink()
    (tmp_path / "d.xlsx").unlink()
    kinds = {os.path.basename(r.path): (r.format, r.accepted) for r in tabular.formats(spark, str(tmp_path)).collect()}
    assert kinds == {"f.tsv": ("text", True), "w.xlsx": ("xlsx", True)}


def test_the_worklist_shuffles_products_not_pairs(spark):
    import re

    plan = QUERIES["discovery_worklist"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(product_id#\d+L, competitor_id#", plan) and "CartesianProduct" not in plan


def test_worklists_of_one_brand_are_spread(spark):
    shops = spark.range(100).select(F.col("id"), (F.col("id") % 7 != 0).alias("enabled"), F.when(F.col("id") % 2 == 0, F.array()).otherwise(F.array(F.when(F.col("id") % 3 == 0, "B").otherwise("A"), F.lit("a"))).alias("brands"))
    products = spark.range(300).select(F.col("id"), F.when(F.col("id") != 5, "a").alias("brand"), F.when(F.col("id") % 9 == 0, F.current_timestamp()).alias("delisted_at"))
    matches = spark.range(300).select(F.col("id").alias("product_id"), (F.col("id") % 100).alias("competitor_id"), F.when(F.col("id") % 4 == 0, "rejected").otherwise("pending").alias("status"))
    live, on = [p for p in range(300) if p % 9], [c for c in range(100) if c % 7]
    want = sorted((p, c) for p in live for c in on if (c % 2 == 0 or p != 5) and not (c == p % 100 and p % 4))
    work = reports.discovery_worklist(products, shops, matches)
    assert sorted(map(tuple, work.collect())) == want
    assert [tuple(r) for r in reports.discovery_worklist(products, shops, matches, 90).collect()] == want[:90]
    named = products.withColumn("brand", F.lit("x"))
    lacked = reports.brand_not_stocked(named, shops)
    assert sorted(map(tuple, lacked.collect())) == [(p, c) for p in live for c in on if c % 2]
    # All products meet one list of shops: many tasks must have their share of it, in the way that rows are shuffled.
    for rows in (work, lacked):
        assert len({r.p for r in rows.withColumn("p", F.spark_partition_id()).collect()}) >= 6


@pytest.mark.parametrize("name", ["brand_not_stocked", "discovery_worklist"])
def test_worklists_are_written_in_short_runs_of_shops(spark, name):
    from pyspark.sql import Window

    shops = spark.range(6000).select("id", F.lit(True).alias("enabled"), F.array(*[F.lit("a")] * (name == "brand_not_stocked")).cast("array<string>").alias("brands"))
    products = spark.range(512).select("id", F.lit("x").alias("brand"), F.lit(None).cast("timestamp").alias("delisted_at"))
    matches = spark.range(5120).select((F.col("id") % 512).alias("product_id"), (F.col("id") * 7 % 6000).alias("competitor_id"), F.lit("pending").alias("status"))
    work = reports.brand_not_stocked(products, shops) if name == "brand_not_stocked" else reports.discovery_worklist(products, shops, matches)
    done = matches.limit(0) if name == "brand_not_stocked" else matches
    assert (work.count(), work.distinct().count()) == (512 * 6000 - done.distinct().count(),) * 2
    assert work.join(done, ["product_id", "competitor_id"], "left_semi").isEmpty()
    # A shop comes again after a run of shops, not after all of them: what a page of a column file holds is few shops, again and again.
    at = work.withColumn("n", F.monotonically_increasing_id()).withColumn("p", F.shiftright("n", 33))
    since = F.col("n") - F.lag("n").over(Window.partitionBy("p", "competitor_id").orderBy("n"))
    assert at.select(since.alias("since")).agg(F.count_if(F.col("since") <= 256) / F.count("*")).first()[0] > 0.4


@pytest.mark.parametrize("name", ["extract_search", "extract_listing", "jsonld_product", "score_candidates"])
def test_costly_rows_of_a_small_file_are_dealt_out(spark, name):
    rows = QUERIES[name](spark, SF).withColumn("p", F.spark_partition_id()).select("p").collect()
    assert len({r.p for r in rows}) >= (4 if name == "score_candidates" else 12)


def test_walked_links_and_asked_terms_are_held_by_no_task(spark, monkeypatch):
    from pricelake.operators import matching

    kept = {}
    spy = lambda module, f: monkeypatch.setattr(module, "workspace", lambda s, name: kept.setdefault(name, f(s, name)))
    spy(pages, pages.workspace)
    links = [(1, "a", "sitemap", "b"), (1, "a", "sitemap", "b"), (1, "b", "sitemap", "a"), (1, "b", "url", "u")]
    entries = spark.createDataFrame(links, "competitor_id int, file string, kind string, loc string")
    got = pages.walked(entries, entries.select("competitor_id", "file").where("file = 'a'"))
    assert sorted((r.file, r.turn) for r in got.collect()) == [("a", 1), ("b", 2)]
    assert spark.read.parquet(f"{kept['walk']}/links").count() == 3
    products = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "product_id long, terms array<string>")
    urls = spark.createDataFrame([(7, "u/x", "x"), (7, "u/xy", "x y")], "competitor_id long, url string, slug string")
    found = matching.candidate_urls(products, urls)
    assert sorted((r.product_id, r.url, r.place) for r in found.collect()) == [(1, "u/x", 2), (1, "u/xy", 1), (2, "u/x", 1), (2, "u/xy", 2)]
    assert "BroadcastHashJoin [question" not in found._jdf.queryExecution().executedPlan().toString()


def test_deep_pages_are_the_same_rows(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b", "c"])) for i in range(400)]
    rng.shuffle(rows)
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    df = spark.createDataFrame(rows, "id long, brand string")
    monkeypatch.setattr(comparison, "SHALLOW", 30)
    order = [F.asc_nulls_last("brand"), F.asc("id")]
    for offset in (0, 21, 100, 395, 400, 900):
        assert [tuple(r) for r in comparison.page(df, order, 10, offset).collect()] == want[offset : offset + 10]
    assert comparison.page(df.where("false"), order, 10, 50).count() == 0


def test_a_deep_walk_ends(spark):
    rows = [(1, f"f{i:02d}", "sitemap", f"f{j:02d}") for i in range(6) for j in (i + 1, 0, i)]
    entries = spark.createDataFrame(rows, "competitor_id int, file string, kind string, loc string")
    roots = spark.createDataFrame([(1, "f00")], "competitor_id int, file string")
    assert [(r.file, r.turn) for r in pages.walked(entries, roots).orderBy("turn").collect()] == [(f"f{i:02d}", i + 1) for i in range(7)]
    assert pages.walked(entries, roots, 4).count() == 4 and pages.walked(entries, roots.where("false")).count() == 0


def test_delimited_files_are_split_anywhere(spark, tmp_path):
    import csv
    import io
    import random

    rng = random.Random(6)
    pieces = ["a", "b c", " ", "é", '"', '""', ",", "\n", "\r\n", "x" * 40, ""]

    def cell():
        x = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))
        kind = rng.random()
        if kind < 0.5:
            return '"' + x.replace('"', '""') + '"' + rng.choice(["", "", " z", '5"'])
        return x.replace(",", "").replace("\n", "").replace("\r", "").replace('"', "") + rng.choice(["", "", ' 5" pipe'])

    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for seed in (0, 3):
            body = "id,t,u\n" + "".join(rng.choice(["", "\n", "\r\n"]) * (rng.random() < 0.1) + f"{i},{cell()},{cell()}" + rng.choice(["\n", "\r\n"]) for i in range(25))
            body += '99,"open\nend' if seed == 3 else ""
            (tmp_path / f"f{seed}.csv").write_bytes(body.encode())
            want = []
            for n, row in enumerate((x for x in csv.reader(io.StringIO(body, newline=""), skipinitialspace=True) if x), 1):
                cells = [x.strip() for x in row]
                if n > 1 and any(cells):
                    want.append((*(cells + [""] * 3)[:3], n))
            for size in (20, 100_000):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                got = tabular.read_delimited(spark, str(tmp_path / f"f{seed}.csv"))
                assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "old.csv").write_bytes(b"id;t\r1;a\r2;b\r")
    assert [tuple(r) for r in tabular.read_delimited(spark, str(tmp_path / "old.csv")).orderBy("row_number").collect()] == [("1", "a", 2), ("2", "b", 3)]
    (tmp_path / "none.csv").write_bytes(b"")
    assert tabular.read_delimited(spark, str(tmp_path / "none.csv")).count() == 0


def test_competitor_files(spark, tmp_path):
    good = {"slug": "a-b", "displayName": "A", "baseUrl": "https://a.co", "searchUrlPattern": "https://a.co/s?q={query}", "config": {"search": {"maxCandidates": 5}}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    row = competitors.read_competitors(spark, str(tmp_path)).first()
    assert (row.enabled, row.scrape_frequency, row.brands, row.config.search.maxCandidates) == (True, "daily", [], 5)
    assert spark.range(1).select(competitors.search_url(F.lit(row.search_url_pattern), F.lit("tag heuer"))).first()[0] == "https://a.co/s?q=tag%20heuer"
    (tmp_path / "b.json").write_text(json.dumps(good | {"slug": "B!"}))
    with pytest.raises(ValueError):
        competitors.read_competitors(spark, str(tmp_path))


def test_csv_export_and_stream(spark, tmp_path):
    out = str(tmp_path / "csv")
    comparison.write_csv(QUERIES["comparison_export"](spark, SF).coalesce(1), out)
    text = next(x for x in os.listdir(out) if x.endswith(".csv"))
    assert open(f"{out}/{text}").readline().startswith("internal_sku,brand,product_name,category,ean_mpn")
    whole = comparison.csv_text(spark.createDataFrame([("a,b", 'c"d', None), ("x", "y\nz", 1.5)], "p string, q string, r double"))
    assert whole == '\ufeffp,q,r\n"a,b","c""d",\nx,"y\nz",1.5'
    assert [r.value for r in comparison.json_rows(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ['{"a":1,"b":null}']
    with pytest.raises(ValueError):
        comparison.asked("unknown")
    rows = spark.createDataFrame([(1, 10.0, "2026-01-01 10:05:00"), (1, 9.0, "2026-01-01 10:50:00"), (1, 5.0, "2026-01-02 00:00:00")], "product_id long, price double, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    append_observations(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.observed_on.day for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 2]
    run = rows.withColumn("run_id", F.lit(1))
    append_batch(run, f"{tmp_path}/out2")
    append_batch(run, f"{tmp_path}/out2")
    append_batch(run.withColumn("run_id", F.lit(2)).limit(1), f"{tmp_path}/out2")
    assert sorted(r.run_id for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == [1, 1, 1, 2]
    with pytest.raises(ValueError):
        append_batch(run.withColumn("run_id", F.lit(None).cast("int")), f"{tmp_path}/out2")
    items = spark.createDataFrame([(1, 7, "ok"), (2, 7, "error"), (3, 8, "ok")], "id long, run_id long, status string")
    append_items(items, f"{tmp_path}/items")
    append_items(items.where("run_id = 8"), f"{tmp_path}/items")
    counts = {r.run_id: (r.ok, r.error) for r in reports.run_counters(spark.read.parquet(f"{tmp_path}/items")).collect()}
    assert counts == {7: (1, 1), 8: (1, 0)}
    q = hourly_prices(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.observations, r.lowest) for r in spark.table("hours").collect()) == [(1, 5.0), (2, 9.0)]


def test_page_titles_against_a_pattern(spark):
    import html
    import re

    got = {r.page_id: r.title for r in QUERIES["page_titles"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        h1 = re.search(r"(?s)<h1[^>]*>(.*?)</h1>", r.html)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", h1[1])).split()) if h1 else None
        assert got[r.page_id] == (want or None)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 100 and "best_price" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, duck, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/got")
    got = duck.sql(f"select * from '{tmp_path}/got/*.parquet'")
    want = duck.sql(ORACLES[name])
    assert dict(zip(got.columns, got.types, strict=True)) == dict(zip(want.columns, want.types, strict=True))
    columns = ",".join(f'"{c}"' for c in sorted(want.columns))
    key = lambda r: sorted(map(str, r))
    assert key(got.select(columns).fetchall()) == key(want.select(columns).fetchall())

import html
import time
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pricelake.functions import linked_data, markup
from pricelake.operators import pages


def each(spark, values, f):
    """What a column function makes of texts."""
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r.y for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_entities_as_the_library_reads_them(spark):
    texts = ["a &amp; b", "&amp;lt;", "&pound;5 &euro;6 &nbsp;&copy x", "&#163;&#xA3;&#x1F600;", "&#0; &#xD800; &#99999999;", "&#150;&#x80;", "&nosuch; & &; &&amp", "", "plain", None, "&AMP;&eacute;&Eacute;"]
    assert each(spark, texts, markup.unescape) == [x if x is None else html.unescape(x).replace("\x00", "\ufffd") for x in texts]


def test_addresses_as_the_library_joins_them(spark):
    bases = ["https://x.co", "https://x.co/", "https://x.co/a/b?q=1#f", "http://x.co/a/b/"]
    links = ["c", "/c", "../c", "../../../c", "./", "..", ".", "?v=1", "#g", "", "//cdn.co/t.png", "http://y.co/z/../w", "c/./d/../e?x=../y#z", " /s p ", "c:8", "a/b/"]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "base string, link string")
    for r in rows.withColumn("got", markup.resolve(F.col("link"), F.col("base"))).collect():
        want = urljoin(r.base, r.link.strip())
        if r.link == "":
            assert r.got == want.partition("#")[0]  # an empty link is the page, without its fragment
        elif r.link == "#g":
            assert r.got in (want, want.replace("x.co#", "x.co/#"))
        elif r.link == "c:8":
            assert r.got is None
        else:
            assert r.got == want, (r.base, r.link)
    odd = spark.createDataFrame([("", "/a"), (None, "https://y.co/a"), ("ftp://x/", "a"), ("https://x.co", "data:x"), ("https://x.co", None), ("https://x.co", "https:///a")], "base string, link string")
    assert [r.got for r in odd.select(markup.resolve(F.col("link"), F.col("base")).alias("got")).collect()] == [None, "https://y.co/a", None, None, None, None]


def test_tags_attributes_and_scripts(spark):
    page = """<LINK rel=icon href='/a b.png' data-href="no"><!-- <link href="/c"> --><script>var x = '<link href="/s">';</script><link href=""/><link rel>"""
    got = each(spark, [page], lambda x: F.transform(markup.tags(x, "link"), lambda t: F.struct(markup.attribute(t, "rel").alias("rel"), markup.attribute(t, "href").alias("href"))))[0]
    assert [tuple(t) for t in got] == [("icon", "/a b.png"), (None, ""), ("", None)]
    kinds = '<script type="a/b">1</script><!--<script type="a/b">2</script>--><script type="a/c">3</script><SCRIPT async type=a/b>"<!--"</SCRIPT><script type="a/b">4'
    assert each(spark, [kinds, None, ""], lambda x: markup.scripts(x, "a/b")) == [["1", '"<!--"', "4"], None, []]


def test_pairs_of_tables_and_lists(spark):
    page = "<tr><th>out</th><td>side</td></tr><dl><dt>A<dt>B</dt> <dd>1 <b>x</b><dt>C</dt><p></p><dd>2</dl><table><tr><th>D<td>3<tr><td>only<tr><td>E</td><td></td><table><tr><td>F<td>4</table><tr><td>G</td><td>5</td></tr></table>"
    got = each(spark, [page, None, "<table>"], lambda x: markup.label_pairs(x))
    assert [[tuple(p) for p in x] for x in got] == [[("B", "1 x"), ("D", "3"), ("F", "4"), ("G", "5")], [], []]


def test_first_product_in_the_order_of_the_page(spark):
    nested = '{"hasVariant":[{"@type":"Product","name":"inner"}],"@graph":{"mainEntity":{"@type":"Product","name":"first"}}}'
    deep = '{"@graph":' * 9 + '{"@type":"Product","name":"too deep"}' + "}" * 9
    texts = [f'<script type="application/ld+json">{x}</script>' for x in (nested, deep, "5", "null", '["a",{"@type":["x","INDIVIDUALPRODUCT"],"name":7.0}]', '{"@type":"Product","name":true}', '{"@type":"Product","name":" "}', '{"@type":"Product","name":12345678.25}', '{"@type":"Product","name":1e3}')]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, html string")
    got = {r.k: r.listing.title for r in pages.extract_listings(rows, {}).collect()}
    assert got == {0: "first", 1: None, 2: None, 3: None, 4: "7", 5: None, 6: None, 7: "12345678.25", 8: "1000"}
    off = pages.extract_listings(rows, {"useJsonLd": False}).where("listing.title IS NOT NULL")
    assert off.count() == 0


def test_no_python_without_selectors(spark):
    rows = spark.createDataFrame([("<h1>x</h1>", "https://x.co")], "html string, url string")
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Python" not in plan(pages.extract_listings(rows, {})) and "Python" not in plan(pages.icon_urls(rows))
    assert "Python" in plan(pages.extract_listings(rows, {"selectors": {"title": [".t"]}}))


def test_hostile_pages_cost_what_their_length_does(spark, tmp_path):
    units = ["<!--", "<script ", "<script>", "<link rel='", "<table><tr><td>", "<dl><dt>", "&", "&#", "<h1", "<", '<script type="application/ld+json">[']
    pages_of = [(unit * (200_000 // len(unit)), "https://x.co") for unit in units]
    spark.createDataFrame(pages_of, "html string, url string").write.parquet(f"{tmp_path}/pages")
    start = time.perf_counter()
    got = pages.icon_urls(pages.extract_listings(spark.read.parquet(f"{tmp_path}/pages"), {})).select("listing", "icons").collect()
    assert len(got) == len(units) and time.perf_counter() - start < 60


def test_columns_come_through(spark):
    rows = spark.createDataFrame([("<h1>x</h1>", "u", 1, None)], "html string, title string, place int, icons string")
    got = pages.extract_listings(rows, {})
    assert got.columns == ["html", "title", "place", "icons", "listing"] and got.first().title == "u"
    assert pages.extract_listings(rows.where("false"), {}).count() == 0
    assert linked_data.DEPTH == 6

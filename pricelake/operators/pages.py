"""Listings from pages: product data, search results, icons, sitemaps, robots rules.

Linked data, tables, headings and icons are read in columns; elements that a
shop's selectors name are sought in Python, a batch of pages at a time.  What goes
wrong with a page is a value in its row, never an exception.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from bisect import bisect_left
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import linked_data, markup, money, rules, text
from pricelake.sources.shared import workspace

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a start tag closes where they are left open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "p": {"p"}}
_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)$")


class Step:
    """One step of a selector: tag, .class, #id, [name], [name=value], [name*=value]."""

    def __init__(self, written: str):
        got = _STEP.match(written)
        self.never = got is None
        self.tag = got[1] if got and got[1] not in (None, "*") else None
        self.classes, self.tests = [], []
        for part in re.findall(r"\.[\w-]+|#[\w-]+|\[[^\]]+\]", got[2]) if got else []:
            if part[0] == ".":
                self.classes.append(part[1:])
            elif part[0] == "#":
                self.tests.append(("id", "=", part[1:]))
            elif (test := re.match(r"([\w:-]+)(\*=|=)?(.*)", part[1:-1])) is None:
                self.never = True
            else:
                self.tests.append((test[1], test[2], test[3].strip("\"'")))

    def fits(self, node: Node) -> bool:
        if self.never or (self.tag is not None and self.tag != node.tag) or not node.classes.issuperset(self.classes):
            return False
        for name, mark, value in self.tests:
            own = node.attributes.get(name)
            if own is None or (mark == "=" and own != value) or (mark == "*=" and value not in own):
                return False
        return True


@lru_cache(maxsize=512)
def _paths(selector: str) -> list[list[Step]]:
    """The alternatives of a selector, each as steps from the outermost element to the one that is sought."""
    return [[Step(y) for y in x.split()] for x in selector.split(",") if x.strip()]


class Node:
    """An element of a page: its tag, attributes, parent, children, and its place and the place behind its last descendant."""

    def __init__(self, page: Page, tag: str, attributes: dict[str, str], parent: Node | None):
        self.page, self.tag, self.attributes, self.parent = page, tag, attributes, parent
        self.classes = frozenset(attributes.get("class", "").split())
        self.children: list[Node | str] = []
        self.place = len(page.nodes)
        self.end = self.place + 1
        page.nodes.append(self)

    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                waiting += reversed(x.children)
        return "".join(out)

    def inside(self, path: list[Step]) -> bool:
        """Whether the element fits a path's last step and has the others around it."""
        if not path[-1].fits(self):
            return False
        up, left = self.parent, len(path) - 1
        while left and up is not None:
            if path[left - 1].fits(up):
                left -= 1
            up = up.parent
        return not left

    def select(self, selector: str) -> list[Node]:
        """The descendants that a selector describes, in the page's order."""
        found: set[int] = set()
        for path in _paths(selector):
            places = self.page.places(path[-1])
            for k in range(bisect_left(places, self.place + 1), bisect_left(places, self.end)):
                if self.page.nodes[places[k]].inside(path):
                    found.add(places[k])
        return [self.page.nodes[k] for k in sorted(found)]


class Page(HTMLParser):
    """A page read once into elements in order, with the places of each tag and class."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.root = self.at = Node(self, "", {}, None)
        self.open: dict[str, int] = {}
        self.feed(html)
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}
        for node in self.nodes[1:]:
            self.by_tag.setdefault(node.tag, []).append(node.place)
            for name in node.classes:
                self.by_class.setdefault(name, []).append(node.place)
        for node in reversed(self.nodes[1:]):
            node.parent.end = max(node.parent.end, node.end)

    def places(self, step: Step) -> list[int] | range:
        """Places that hold all elements that fit a step."""
        lists = [self.by_class.get(x, []) for x in step.classes] + ([self.by_tag.get(step.tag, [])] if step.tag else [])
        return min(lists, key=len) if lists else range(1, len(self.nodes))

    def _up(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        while self.at.tag in closes:
            self._up()
        self.handle_startendtag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.children[-1]
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(self, tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while self.at.tag != tag:
                self._up()
            self._up()

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str | None) -> Node:
    return Page(html or "").root


def _clean(x: str | None) -> str:
    return " ".join((x or "").split())


def first_text(root: Node, selectors: list[str] | None) -> str | None:
    """The first non-empty content, data-price or text of the selectors' first elements."""
    for selector in selectors or []:
        for node in root.select(selector)[:1]:
            own = node.attributes
            if got := _clean(own.get("content", own.get("data-price", node.text()))):
                return got
    return None


_CHOSEN = "title string, price string, was_price string, availability string, promo_badge boolean, ean string, error_kind string"


def read_chosen(html: str | None, config: dict) -> dict:
    """What a shop's own selectors give of a product page.  What cannot be read is an error kind."""
    css = config.get("selectors") or {}
    markers = config.get("sanityContains") or []
    try:
        root = parse_html(html)
        if markers and not any(root.select(x) for x in markers):
            return {"error_kind": "layout_changed"}
        names = {"title": "title", "price": "price", "was_price": "wasPrice", "availability": "availability", "ean": "ean"}
        return {k: first_text(root, css.get(x)) for k, x in names.items()} | {"promo_badge": first_text(root, css.get("promoBadge")) is not None}
    except Exception as fault:  # whatever a page holds, it must not end the job
        return {"error_kind": f"unreadable: {type(fault).__name__}"}


def _chosen(html_col: str, config: dict) -> Column:
    """A struct of what the shop's selectors give; without selectors no page is read in Python."""
    if not any((config.get("selectors") or {}).values()) and not config.get("sanityContains"):
        return F.lit(None).cast(f"struct<{_CHOSEN.replace(' string', ':string').replace(' boolean', ':boolean')}>")

    @F.pandas_udf(_CHOSEN)
    def read(htmls: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in _CHOSEN.split(", ")]
        found = [read_chosen(x, config) for x in htmls]
        return pd.DataFrame([{n: f.get(n) for n in names} for f in found], columns=names)

    return read(html_col)


def extract_listings(pages: DataFrame, config: dict, html_col: str = "html") -> DataFrame:
    """Adds listing, a struct, to pages: title, price, was_price, currency, promo, in_stock, ean, brand, attributes, source, error_kind.

    Linked data, headings, tables and definition lists are read in columns; only
    a shop's own selectors need the page's elements (Python, a batch at a time).
    A null page has nothing.  Columns that begin with __ld_ are this function's own.
    """
    html, use = F.col(html_col), config.get("useJsonLd", True)
    df = pages.withColumns({"__ld_css": _chosen(html_col, config), "__ld_0": linked_data.read(html) if use else F.array().cast("array<struct<place:string,value:variant>>")})
    levels = ["__ld_0"]
    for k in range(linked_data.DEPTH):
        df = df.withColumn(f"__ld_{k + 1}", linked_data.below(F.col(levels[-1])))
        levels.append(f"__ld_{k + 1}")
    df = df.withColumns({"__ld_all": F.concat(*levels), "__ld_body": markup.body(html)}).drop(*levels)
    df = df.withColumns({"__ld_product": linked_data.first_of(F.col("__ld_all"), "product", "individualproduct"), "__ld_offer": linked_data.first_of(F.col("__ld_all"), "offer", "aggregateoffer")})
    product, css = F.col("__ld_product"), F.col("__ld_css")
    offer = F.when(product.isNotNull(), F.col("__ld_offer"))
    of, sold = (lambda key: linked_data.word(linked_data.member(product, key))), (lambda key: linked_data.word(linked_data.member(offer, key)))
    spec = linked_data.as_object(linked_data.member(offer, "priceSpecification"))
    prices = F.array(sold("price"), sold("lowPrice"), linked_data.word(linked_data.member(spec, "price")))
    pairs = F.transform(markup.label_pairs(F.col("__ld_body")), lambda x: F.struct(text.canonical_attribute(x.key).alias("key"), x.value.alias("value")))
    df = df.withColumns(
        {
            "__ld_pairs": F.concat(linked_data.product_attributes(product), pairs),
            "__ld_json": F.get(F.filter(F.transform(prices, money.parse_price), lambda x: x.isNotNull()), F.lit(0)),
            "__ld_price": money.parse_price(css.price),
            "__ld_was": money.parse_price(css.was_price),
            "__ld_availability": F.coalesce(css.availability, sold("availability")),
        }
    )
    seen, chosen, was = F.col("__ld_json"), F.col("__ld_price"), F.col("__ld_was")
    price = F.coalesce(seen, chosen)
    kind = F.coalesce(css.error_kind, F.when(price.isNull(), "no_price_found").when((price <= 0) | (price > rules.MAX_PRICE), "implausible_price"))
    known = css.error_kind.isNull()
    raised = known & F.coalesce(was > price, F.lit(False))
    only = lambda c: F.when(known, c)
    listing = F.struct(
        only(F.coalesce(of("name"), css.title, markup.first_element(F.col("__ld_body"), "h1"))).alias("title"),
        F.when(kind.isNull(), price).alias("price"),
        F.when(kind.isNull() & raised, was).alias("was_price"),
        only(F.coalesce(sold("priceCurrency"), of("priceCurrency"), F.lit("GBP"))).alias("currency"),
        (F.coalesce(css.promo_badge, F.lit(False)) | raised).alias("promo"),
        only(text.availability(F.col("__ld_availability"))).alias("in_stock"),
        only(F.col("__ld_availability")).alias("availability"),
        only(F.coalesce(*[of(k) for k in rules.LINKED_IDENTIFIERS], css.ean)).alias("ean"),
        only(of("brand")).alias("brand"),
        only(linked_data.first_of_each(F.col("__ld_pairs"))).alias("attributes"),
        F.when(known & seen.isNotNull(), "json-ld").when(known & chosen.isNotNull(), "selector").otherwise("none").alias("source"),
        kind.alias("error_kind"),
    )
    # Exploded from an array of one, so that a filter on it isn't spelt out again for each of its parts.
    return df.select(*pages.columns, F.explode(F.array(listing)).alias("listing"))


def _address(href: str, base: str) -> str | None:
    try:
        out = urljoin(base, href.strip())
        return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
    except ValueError:
        return None


def search_results(pages: DataFrame, config: dict, base_url: str, html_col: str = "html") -> DataFrame:
    """A row for each result of a search page: adds place, url, title, price; an address counts once."""
    item, most = ", ".join(config.get("resultItem") or []), config.get("maxCandidates", 10)
    link, title, cost = (", ".join(config.get(k) or d) for k, d in (("resultLink", ["a"]), ("resultTitle", []), ("resultPrice", [])))

    def read(html: str | None) -> list[tuple[str, str, str | None]]:
        try:
            return hits(html)
        except Exception:  # whatever a page holds, it must not end the job
            return []

    def hits(html: str | None) -> list[tuple[str, str, str | None]]:
        out: dict[str, tuple[str, str, str | None]] = {}
        for node in parse_html(html).select(item) if item else []:
            links = node.select(link)
            href = links[0].attributes.get("href") if links else node.attributes.get("href")
            at = _address(href, base_url) if href else None
            if at is None or at in out or len(out) >= most:
                continue
            named = node.select(title)[:1] if title else []
            anchors = node.select("a")[:1]
            words = (named[0].text() if named else "") or (anchors[0].attributes.get("title", "") if anchors else "") or node.text()
            priced = node.select(cost)[:1] if cost else []
            out[at] = (at, _clean(words)[:300], priced[0].text() if priced else None)
        return list(out.values())

    @F.pandas_udf("array<struct<url string, title string, raw string>>")
    def results(htmls: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("url", "title", "raw"), r, strict=True)) for r in read(x)] for x in htmls])

    rows = pages.select("*", F.posexplode(results(html_col)).alias("place", "_hit"))
    return rows.select(*[c for c in pages.columns if c not in (html_col, "url")], "place", "_hit.url", "_hit.title", money.parse_price(F.col("_hit.raw")).alias("price"))


# Link relations of icons, the best first.
ICON_RELATIONS = [r"^apple-touch-icon(-precomposed)?$", r"^icon$", r"^shortcut icon$", r"^mask-icon$"]


def icon_urls(pages: DataFrame, html_col: str = "html", base_col: str = "url") -> DataFrame:
    """Adds icons, the addresses of a page's icons: by relation, then the larger; the site's default is last."""

    base = F.col(base_col)
    links = F.transform(markup.tags(F.col(html_col), "link"), lambda x: F.struct(markup.attribute(x, "rel").alias("rel"), markup.attribute(x, "href").alias("href"), markup.attribute(x, "sizes").alias("sizes")))

    def ranked(x: Column, i: Column) -> Column:
        relation, rank = F.lower(F.trim(x.rel)), F.lit(None).cast("int")
        for k, pattern in reversed(list(enumerate(ICON_RELATIONS))):
            rank = F.when(relation.rlike(pattern), k).otherwise(rank)
        size = F.coalesce(F.regexp_extract(x.sizes, r"^\d{1,9}", 0).try_cast("int"), F.lit(0))
        return F.struct(rank.alias("rank"), (-size).alias("larger"), i.alias("place"), markup.resolve(x.href, base).alias("at"))

    found = F.filter(F.transform(links, ranked), lambda x: x["rank"].isNotNull() & x["at"].isNotNull())
    last = F.filter(F.array(markup.resolve(F.lit("/favicon.ico"), base)), lambda x: x.isNotNull())
    icons = F.array_distinct(F.concat(F.transform(F.sort_array(found), lambda x: x["at"]), last))
    return pages.withColumn("icons", F.coalesce(icons, last))


#: The largest sitemap file that is read, in bytes, packed or not.
SITEMAP_MOST = 50 << 20


def sitemap_bodies(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds body and error to fetched sitemap files (binary): unpacked if they are gzip by their first bytes, refused if too large or broken."""

    def read(content: bytes | None) -> tuple[str | None, str | None]:
        if content is None:
            return None, "no content"
        if len(content) > SITEMAP_MOST:
            return None, f"{len(content) >> 20} MB are too much for a sitemap"
        if content[:2] != b"\x1f\x8b":
            return content.decode("utf-8", "replace"), None
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(content)) as packed:
                plain = packed.read(SITEMAP_MOST + 1)
        except (OSError, EOFError, zlib.error) as fault:
            return None, str(fault) or "broken gzip"
        return (plain.decode("utf-8", "replace"), None) if len(plain) <= SITEMAP_MOST else (None, "unpacked, it is too much for a sitemap")

    @F.pandas_udf("body string, error string")
    def bodies(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) for x in contents], columns=["body", "error"])

    out = files.withColumn("_read", bodies(content_col))
    return out.select(*[c for c in files.columns if c != content_col], "_read.body", "_read.error")


def sitemap_entries(files: DataFrame, body_col: str = "body") -> DataFrame:
    """A row for each entry of sitemap files: adds place (in the file), kind (url or sitemap), loc, lastmod; entries without address are left out."""
    entry = F.posexplode(F.regexp_extract_all(F.col(body_col), F.lit(r"(?is)(<(url|sitemap)\b.*?</\2>)"), F.lit(1)))
    rows = files.select(*[c for c in files.columns if c != body_col], entry.alias("place", "_entry"))
    plain = F.regexp_extract("_entry", r"(?is)<loc>\s*(.*?)\s*</loc>", 1)
    for mark, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(character))
    kind = F.when(F.col("_entry").rlike(r"(?i)^<sitemap[\s>]"), "sitemap").otherwise("url")
    changed = F.nullif(F.regexp_extract("_entry", r"(?is)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit(""))
    return rows.select("*", kind.alias("kind"), F.trim(plain).alias("loc"), F.when(kind == "url", changed).alias("lastmod")).drop("_entry").where("loc != ''")


def walked(entries: DataFrame, roots: DataFrame, most_files: int = 100) -> DataFrame:
    """(competitor_id, file, turn): the sitemap files reached from the declared ones (roots: competitor_id, file).

    entries: sitemap_entries() with competitor_id and file.  Level by level, a
    file once, so cycles end; of each shop the first most_files in order of level
    and address.  Each level is written and read again: a step costs one look at
    the links, however many came before it.  A link told twice is told twice here,
    so that no task has to hold links; files are counted once all the same.
    """
    spark, place = entries.sparkSession, workspace(entries.sparkSession, "walk")
    entries.where("kind = 'sitemap'").select("competitor_id", "file", F.col("loc").alias("child")).write.parquet(f"{place}/links")
    links = spark.read.parquet(f"{place}/links")
    new = roots.select("competitor_id", "file").distinct()
    for level in range(most_files):
        new.write.parquet(f"{place}/reached/level={level}")
        frontier, reached = spark.read.parquet(f"{place}/reached/level={level}"), spark.read.parquet(f"{place}/reached")
        if frontier.isEmpty():
            break
        # A shop that has its files looks no further.
        full = reached.groupBy("competitor_id").agg(F.count("*").alias("n")).where(F.col("n") >= most_files)
        further = frontier.join(full, "competitor_id", "left_anti").join(links, ["competitor_id", "file"])
        new = further.select("competitor_id", F.col("child").alias("file")).distinct().join(reached, ["competitor_id", "file"], "left_anti")
    order = Window.partitionBy("competitor_id").orderBy("level", "file")
    return reached.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most_files).drop("level")


def harvest(entries: DataFrame) -> DataFrame:
    """The distinct addresses of all sitemap files with their words; of an address told twice the first one's last change, if it can be read.

    The first is that of the earlier file (turn, where walked() has told it), there
    the earlier entry (place).
    """
    own = [F.col(c) if c in entries.columns else F.lit(0).alias(c) for c in ("turn", "place")]
    rows = entries.where("kind = 'url'").select("competitor_id", F.col("loc").alias("url"), F.try_to_timestamp("lastmod").alias("lastmod"), *own)
    urls = rows.groupBy("competitor_id", "url").agg(F.min_by("lastmod", F.struct("turn", "place")).alias("lastmod"))
    return urls.withColumn("slug", text.slug_words(F.col("url")))


def survey(competitors: DataFrame, declared: DataFrame, files: DataFrame, entries: DataFrame, children: int = 3, samples: int = 10) -> DataFrame:
    """What each shop's sitemaps hold, by a bounded look: competitor_id, declared, read, failed, indexes, total_urls, sample, error, first_fault.

    competitors: (competitor_id, error: why no sitemap may be sought, or null);
    declared: (competitor_id, file); files: (competitor_id, file, error);
    entries: sitemap_entries() of files.  Looked at are the declared files and of
    those that they list the first few.
    """
    first = Window.partitionBy("competitor_id").orderBy("file", "place")
    listed = entries.where("kind = 'sitemap'").join(declared, ["competitor_id", "file"], "left_semi").select("competitor_id", "file", "place", "loc")
    followed = listed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= children).select("competitor_id", F.col("loc").alias("file"))
    seen = files.join(declared.select("competitor_id", "file").union(followed).distinct(), ["competitor_id", "file"], "left_semi")
    told = entries.join(seen.select("competitor_id", "file"), ["competitor_id", "file"], "left_semi")
    per_file = told.groupBy("competitor_id", "file").agg(F.count_if(F.col("kind") == "sitemap").alias("maps"), F.count_if(F.col("kind") == "url").alias("urls"))
    read = F.col("error").isNull()
    looked = seen.join(per_file, ["competitor_id", "file"], "left").groupBy("competitor_id").agg(
        F.count_if(read).alias("read"),
        F.count_if(~read).alias("failed"),
        F.count_if(read & (F.col("maps") > 0)).alias("indexes"),
        F.coalesce(F.sum("urls"), F.lit(0)).alias("total_urls"),
        F.min_by("error", F.when(~read, F.col("file"))).alias("first_fault"),
    )
    sampled = told.where("kind = 'url'").withColumn("n", F.row_number().over(first)).where(F.col("n") <= samples)
    sampled = sampled.groupBy("competitor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "loc"))), lambda x: x["loc"]).alias("sample"))
    out = competitors.join(declared.groupBy("competitor_id").agg(F.count("*").alias("declared")), "competitor_id", "left")
    out = out.join(looked, "competitor_id", "left").join(sampled, "competitor_id", "left")
    out = out.fillna(0, ["declared", "read", "failed", "indexes", "total_urls"])
    return out.withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))


# What a survey's outcome is called.
VERDICTS = ["Usable", "Blocked at robots.txt", "No route", "Index only", "Sitemap unreadable", "None published", "Empty"]


def sitemap_verdict(error: Column, total: Column, indexes: Column, failed: Column, declared: Column) -> Column:
    """A survey's outcome in a word or two."""
    usable, blocked, no_route, index, unreadable, none, empty = VERDICTS
    return (
        F.when(total > 0, usable)
        .when(error.rlike(r"(?i)robots\.txt"), blocked)
        .when(error.isNotNull(), no_route)
        .when(indexes > 0, index)
        .when(failed > 0, unreadable)
        .when(declared == 0, none)
        .otherwise(empty)
    )


def survey_summary(surveys: DataFrame) -> DataFrame:
    """One row: shops with a usable sitemap, those that declare one, those that failed."""
    failed = F.col("error").isNotNull() | (F.col("total_urls") == 0)
    return surveys.agg(F.count_if(F.col("total_urls") > 0).alias("usable"), F.count_if(F.col("declared") > 0).alias("declaring"), F.count_if(failed).alias("failed"))


def robots_rules(files: DataFrame, agent: str, body_col: str = "body", key: str = "site") -> DataFrame:
    """(site, place, rule): what robots files forbid to an agent.  The last User-agent line before a rule decides."""
    lines = files.select(key, F.posexplode(F.split(body_col, r"\r?\n")).alias("line", "_raw"))
    lines = lines.withColumn("_text", F.trim(F.regexp_replace("_raw", "#.*$", ""))).where("_text != ''")
    name, value = F.lower(F.trim(F.substring_index("_text", ":", 1))), F.trim(F.regexp_replace("_text", "^[^:]*:?", ""))
    target = F.lower(value)
    applies = F.when(name == "user-agent", (target == "*") | F.contains(F.lit(agent.lower()), target))
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_applies", F.last(applies, ignorenulls=True).over(so_far))
    kept = lines.where((name == "disallow") & (value != "") & F.col("_applies")).groupBy(key, value.alias("rule"))
    return kept.agg(F.min("line").alias("place"))


def path_of(url: Column) -> Column:
    """An address's path with its query, as robots rules see it."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))


def _rule_parts(rule: Column) -> tuple[Column, Column, Column]:
    """A robots rule's literal beginning, the literal parts after each *, and whether it holds for whole paths ($)."""
    whole = rule.endswith("$")
    parts = F.split(F.when(whole, F.left(rule, F.length(rule) - 1)).otherwise(rule), r"\*")
    return F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.size(parts)), whole


def rule_fits(path: Column, rule: Column) -> Column:
    """Whether a robots rule covers a path: a prefix, * for any characters, $ for the end.

    The parts between stars are sought one after the other, each from where the
    one before it ended, so that no rule makes a search try a place twice.
    """
    head, rest, whole = _rule_parts(rule)
    inner = F.filter(F.when(whole, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest), lambda x: x != "")
    tail = F.coalesce(F.get(rest, F.size(rest) - 1), F.lit(""))

    def after(at: Column, part: Column) -> Column:
        found = F.when(at > 0, F.position(part, path, at)).otherwise(0)
        return F.when(found > 0, found + F.length(part)).otherwise(0)

    end = F.aggregate(inner, F.length(head) + 1, after)
    ends_well = ~whole | F.when(F.size(rest) == 0, path == head).otherwise(path.endswith(tail) & (F.length(path) - F.length(tail) + 1 >= end))
    return path.startswith(head) & (end > 0) & ends_well


def robots_groups(files: DataFrame, agent: str, body_col: str = "body", key: str = "site") -> DataFrame:
    """(site, allow, rule): what robots files say to an agent: of the group that names it, else of the one for all.

    User-agent lines in a row open one group; a group ends where the next begins.
    """
    lines = files.select(key, F.posexplode(F.split(body_col, r"\r?\n")).alias("line", "_raw"))
    lines = lines.withColumn("_text", F.trim(F.regexp_replace("_raw", "#.*$", ""))).where(F.col("_text").contains(":"))
    name, value = F.lower(F.trim(F.substring_index("_text", ":", 1))), F.trim(F.regexp_replace("_text", "^[^:]*:", ""))
    lines = lines.select(key, "line", name.alias("name"), value.alias("value")).where("name in ('user-agent', 'allow', 'disallow')")
    up_to = Window.partitionBy(key).orderBy("line")
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(up_to), F.lit("")) != "user-agent")
    lines = lines.withColumn("part", F.sum(begins.cast("int")).over(up_to))
    target = F.lower("value")
    mine = F.when(target == "*", 1).when((target != "") & F.contains(F.lit(agent.lower()), target), 2)
    parts = lines.where("name = 'user-agent'").groupBy(key, "part").agg(F.max(mine).alias("fit")).where("fit is not null")
    best = parts.groupBy(key).agg(F.max("fit").alias("fit"))
    chosen = parts.join(best, [key, "fit"]).select(key, "part")
    rules = lines.where("name != 'user-agent' and value != ''").join(chosen, [key, "part"])
    return rules.select(key, (F.col("name") == "allow").alias("allow"), F.col("value").alias("rule")).distinct()


def robots_probe(urls: DataFrame, groups: DataFrame, key: str = "site") -> DataFrame:
    """urls (site, url, ...) with disallowed: the longest rule that covers the path decides, of equals that which allows.

    A rule is looked up by its beginning up to the first star: a path asks for
    those of its own beginnings that are as long as some rule's of its site, and
    meets only rules that begin like it.
    """
    rules = groups.select(key, "allow", "rule").distinct().withColumn("head", _rule_parts(F.col("rule"))[0])
    lengths = rules.groupBy(key).agg(F.collect_set(F.length("head")).alias("lengths"))
    asked = urls.select(key, "url").distinct().withColumn("path", path_of(F.col("url"))).join(lengths, key)
    asked = asked.select(key, "url", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.select(key, "url", "path", F.expr("left(path, n)").alias("head"))
    hits = asked.join(rules, [key, "head"]).where(rule_fits(F.col("path"), F.col("rule")))
    decided = hits.groupBy(key, "url").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("_allow"))
    return urls.join(decided, [key, "url"], "left").withColumn("disallowed", ~F.coalesce("_allow", F.lit(True))).drop("_allow")


def inspect_robots(files: DataFrame, probes: DataFrame, agent: str) -> DataFrame:
    """For each site: state (ok, absent, unreachable), disallowed rules, and whether its probe address may be read.

    files: (site, status, body); probes: (site, url).
    """
    gone, fetched = F.col("status").isin(404, 410), F.col("status").isNotNull() & (F.col("status") < 400)
    state = F.when(gone, "absent").when(fetched, "ok").otherwise("unreachable")
    rules = robots_rules(files.where(fetched), agent).groupBy("site").agg(F.count("*").alias("disallow_rules"))
    probed = robots_probe(probes, robots_groups(files.where(fetched), agent)).select("site", "url", "disallowed")
    out = files.select("site", "status", state.alias("state")).join(probed, "site", "left").join(rules, "site", "left")
    may = F.when(F.col("url").isNotNull(), allowed(F.col("status"), F.col("disallowed")))
    return out.select("site", "state", "url", may.alias("allowed"), F.coalesce("disallow_rules", F.lit(0)).alias("disallow_rules"))


def robots_summary(inspected: DataFrame) -> DataFrame:
    """One row: sites whose probe may be read, those where it may not, those out of reach."""
    may = F.col("allowed")
    return inspected.agg(F.count_if(may).alias("search_allowed"), F.count_if(~may).alias("search_blocked"), F.count_if(F.col("state") == "unreachable").alias("unreachable"))


def allowed(status: Column, disallowed: Column) -> Column:
    """Whether a page may be read: not where its robots file was out of reach; freely where there is none."""
    return F.when(status.isin(404, 410), True).when(status.isNull() | (status >= 400), False).otherwise(~F.coalesce(disallowed, F.lit(False)))

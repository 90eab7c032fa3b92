"""HTML in columns: tags, attributes, plain text, addresses.

Every pattern takes what is never closed up to the text's end and stops a tag at
the next one, so that work grows with the length of a page, whatever it holds.  A
tag with '<' or '>' in an attribute's value ends there.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_APART = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\b[^<>]*>|\z)"
_SPACE = r"(?U)\s+"


def _cp1252() -> dict[str, str]:
    """What numbers from 128 to 159 stand for: the characters of that code page."""
    out = {}
    for n in range(128, 160):
        try:
            out[f"#{n}"] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return out


#: Entities by name: those with a code point of their own, and those that need no semicolon.
ENTITIES = {f"{k};": chr(n) for k, n in name2codepoint.items()} | {k + end: c for k, c in html5.items() if not k.endswith(";") for end in ("", ";")} | {"apos;": "'"} | _cp1252()


def unescape(x: Column) -> Column:
    """The text with its entities as characters; unknown ones stay as they are, numbers of no character become U+FFFD."""
    named = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def plain(token: Column) -> Column:
        body = F.regexp_extract(token, r"^&(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*;?)", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 8)).try_cast("long")
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        known = F.try_element_at(named, F.when(body.startswith("#"), F.concat(F.lit("#"), number.cast("string"))).otherwise(body))
        return F.when(~token.startswith("&"), token).otherwise(F.coalesce(known, F.when(body.startswith("#"), character), token))

    tokens = F.regexp_extract_all(x, F.lit(r"[^&]+|&(?:#\d{1,8};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]{1,30};?)|&"), F.lit(0))
    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(tokens, plain), "")).otherwise(x)


def tidy(x: Column) -> Column:
    """Without white space at the ends, and one space for each other stretch of it."""
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def body(html: Column) -> Column:
    """A page without comments, scripts and styles."""
    return F.regexp_replace(html, _APART, "")


def plain_text(fragment: Column) -> Column:
    """The words of a fragment of a page."""
    return tidy(unescape(F.regexp_replace(fragment, r"(?s)</?[a-zA-Z!?][^<>]*>", "")))


def first_element(html: Column, tag: str) -> Column:
    """The words of the first element of a kind; null where there is none or it has none."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^<>]*>(.*?)(?:</{tag}\b|\z)"), F.lit(1))
    return F.nullif(plain_text(F.get(found, F.lit(0))), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute: empty if it has none of its own, null without the attribute."""
    at = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))"
    value = F.concat(*[F.regexp_extract(tag, at, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(rf"(?is)[\s\"'/]{name}(?:\s|=|/|>|$)"), unescape(value))


def tags(html: Column, name: str) -> Column:
    """The start tags of a kind outside comments, scripts and styles, in order."""
    return F.regexp_extract_all(body(html), F.lit(rf"(?is)<{name}\b[^<>]*>"), F.lit(0))


def scripts(html: Column, kind: str) -> Column:
    """The contents of a page's scripts of a type, in order; those within comments are none."""
    every = F.regexp_extract_all(html, F.lit(r"(?is)<!--.*?(?:-->|\z)|<script\b[^<>]*>.*?(?:</script\b|\z)"), F.lit(0))
    head = lambda x: F.regexp_extract(x, r"(?is)^<script\b[^<>]*>", 0)
    own = F.filter(every, lambda x: attribute(head(x), "type") == kind)
    return F.transform(own, lambda x: F.regexp_replace(F.substring(x, F.length(head(x)) + 1, F.length(x)), r"(?i)</script\z", ""))


def label_pairs(html: Column) -> Column:
    """(key, value) of a page's definition lists, then of table rows with two cells; both have words, keys fewer than 60 characters.

    A term counts if the next element beside it is its definition.  A row that
    holds a table of its own is read up to that table.
    """
    after = lambda start: F.regexp_extract(html, rf"(?is)<{start}\b.*\z", 0)
    own = lambda x, tag: plain_text(F.regexp_extract(x, rf"(?is)^<{tag}\b[^<>]*>(.*?)(?:</{tag}\b|\z)", 1))
    chunks = F.regexp_extract_all(after("dl"), F.lit(r"(?is)<d[td]\b[^<>]*>.*?(?=<d[td]\b|</dl\b|\z)"), F.lit(0))
    beside = F.zip_with(chunks, F.slice(chunks, F.lit(2), F.size(chunks)), lambda x, y: F.struct(x.alias("term"), y.alias("means")))
    apart = lambda x: F.contains(F.regexp_extract(x, r"(?is)</dt\s*>(.*)\z", 1), F.lit("<"))
    terms = F.filter(beside, lambda x: x.term.rlike("(?i)^<dt") & x.means.rlike("(?i)^<dd") & ~apart(x.term))
    listed = F.transform(terms, lambda x: F.struct(own(x.term, "dt").alias("key"), own(x.means, "dd").alias("value")))
    rows = F.regexp_extract_all(after("table"), F.lit(r"(?is)<tr\b[^<>]*>.*?(?=<tr\b|</tr\b|</table\b|\z)"), F.lit(0))
    cells = lambda x: F.regexp_extract_all(x, F.lit(r"(?is)<t[hd]\b[^<>]*>(.*?)(?=<t[hd]\b|</t[hd]\b|\z)"), F.lit(1))
    two = F.filter(F.transform(rows, cells), lambda x: F.size(x) == 2)
    tabled = F.transform(two, lambda x: F.struct(plain_text(F.get(x, F.lit(0))).alias("key"), plain_text(F.get(x, F.lit(1))).alias("value")))
    good = F.filter(F.concat(listed, tabled), lambda x: (x.key != "") & (x.value != "") & (F.length(x.key) < 60))
    return F.coalesce(good, F.array().cast("array<struct<key:string,value:string>>"))


def resolve(href: Column, base: Column) -> Column:
    """The http address that a link of a page leads to; null for other schemes and where the page's own address is none."""
    link, base = F.trim(F.regexp_replace(href, r"[\t\r\n]", "")), F.coalesce(base, F.lit(""))
    root = F.regexp_extract(base, r"(?i)^https?://[^/?#]+", 0)
    path = F.regexp_extract(base, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own, tail = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path, r"^.*/", 0))
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    parts = F.split(F.substring(whole, 2, F.length(whole)), "/")
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    ends = F.element_at(parts, -1).isin(".", "..")
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, step), "/"))
    walked = F.when(ends & ~walked.endswith("/"), F.concat(walked, F.lit("/"))).otherwise(walked)
    relative = F.when(own != "", F.concat(root, walked, tail)).when(tail.startswith("?"), F.concat(root, path, tail)).otherwise(F.concat(root, path, query, tail))
    return (
        F.when(link.rlike(r"(?i)^https?://[^/?#]"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(root == "", F.lit(None))
        .when(link.rlike(r"^//[^/?#]"), F.concat(F.regexp_extract(root, "^[^:]+:", 0), link))
        .otherwise(relative)
    )

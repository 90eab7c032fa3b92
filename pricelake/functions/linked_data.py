"""Linked data of pages (JSON in scripts) as variants: every object with its holders, and words taken from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelake.functions import markup, rules, text

_OBJECT = "map<string,variant>"
#: How deep holders and lists are followed.
DEPTH = 6


def _as(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def member(node: Column, key: str) -> Column:
    """An object's member, a variant; null without."""
    return F.try_element_at(node, F.lit(key))


def as_object(x: Column) -> Column:
    """The members of a variant that is an object; null for anything else."""
    return _as(x, _OBJECT)


def word(x: Column) -> Column:
    """The text of a variant: a text or number, or an object's name or @value; null for all else and for blank texts."""
    own = as_object(x)
    named = F.when(F.map_contains_key(own, F.lit("name")), member(own, "name")).otherwise(member(own, "@value"))
    value = F.when(own.isNotNull(), named).otherwise(x)
    kind, raw = F.schema_of_variant(value), _as(value, "string")
    wide = F.when(raw.rlike("[eE]"), raw.try_cast("decimal(38,10)").cast("string")).otherwise(raw)
    number = F.when(F.contains(wide, F.lit(".")), F.regexp_replace(wide, r"\.?0+$", "")).otherwise(wide)
    written = F.nullif(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.when(kind == "STRING", written).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), number)


def entries(x: Column) -> Column:
    """The members of a list, or the one value that is none; none for null."""
    return F.coalesce(_as(x, "array<variant>"), F.when(x.isNotNull(), F.array(x)), F.array().cast("array<variant>"))


def is_kind(node: Column, *kinds: str) -> Column:
    """Whether an object's @type, or one of several, is of a kind, whatever its address and case."""
    own = F.filter(entries(member(node, "@type")), lambda t: F.schema_of_variant(t) == "STRING")
    return F.exists(own, lambda t: F.substring_index(F.lower(_as(t, "string")), "/", -1).isin(*kinds))


_ITEM = "struct<place:string,value:variant>"


def _item(place: Column, value: Column) -> Column:
    return F.struct(place.alias("place"), value.alias("value"))


def _number(i: Column) -> Column:
    return F.lpad(i.cast("string"), 7, "0")


def read(html: Column) -> Column:
    """(place, value) of a page's scripts of linked data: the first level.

    A script that is no JSON holds nothing, nor does one with a key twice in an
    object (unless spark.sql.variant.allowDuplicateKeys is set).
    """
    found = F.transform(markup.scripts(html, "application/ld+json"), lambda x, i: _item(_number(i), F.try_parse_json(x)))
    return F.filter(found, lambda x: x.value.isNotNull())


def below(level: Column) -> Column:
    """(place, value) of what a level's lists and objects hold.

    place sorts as the page has it: an object before what it holds, holders in
    the order of rules.LINKED_HOLDERS.
    """

    def of(x: Column) -> Column:
        listed = F.transform(_as(x.value, "array<variant>"), lambda y, i: _item(F.concat(x.place, _number(i)), y))
        held = [_item(F.concat(x.place, F.lit(f"{i:07d}")), member(as_object(x.value), key)) for i, key in enumerate(rules.LINKED_HOLDERS)]
        return F.filter(F.coalesce(listed, F.array(*held)), lambda y: y.value.isNotNull())

    return F.flatten(F.transform(level, of))


def first_of(nodes: Column, *kinds: str) -> Column:
    """The members of the first object of some kinds among (place, value); null without."""
    own = F.filter(nodes, lambda x: is_kind(as_object(x.value), *kinds))
    least = F.aggregate(own, F.lit(None).cast(_ITEM), lambda done, x: F.when(done.isNull() | (x.place < done.place), x).otherwise(done))
    return as_object(least.value)


def product_attributes(product: Column) -> Column:
    """(key, value) of a product under canonical names: its further properties, the last first, then those of its own."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    more = F.transform(entries(member(product, "additionalProperty")), as_object)
    more = F.transform(more, lambda x: pair(text.canonical_attribute(word(member(x, "name"))), word(member(x, "value"))))
    own = F.array(*[pair(F.lit(target), word(member(product, key))) for key, target in rules.LINKED_ATTRIBUTES.items()])
    return F.filter(F.concat(F.reverse(more), own), lambda x: x.key.isNotNull() & x.value.isNotNull())


def first_of_each(pairs: Column) -> Column:
    """A map of (key, value), a column of its own (it is looked at for every key); of equal keys the first counts."""
    keys = F.transform(pairs, lambda x: x.key)
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x.key) == i + 1))

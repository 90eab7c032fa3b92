"""Near-duplicate components from bottom-k sketches.

One hash function orders all shingles; a document's sketch is its k smallest
values.  The rarest of them are its retained values, whose inverted lists yield
documents that overlap: two sketches that share enough share one of each one's
rarest.  The Jaccard similarity is estimated from the sketch of the union, and
what may be similar enough is compared on the full sets.

Sizes: documents with equal sets are one from the start.  A short list gives its
pairs, a bounded number for each entry.  A long list (a large group of near
copies, or documents made of frequent shingles) is peeled: everyone is compared
with one pivot, the member whose values are the most frequent, which settles
most of the group.  Members near a pivot are then known by what they add to it or
lack of it.  Those not linked with it meet the others of that star by these
differences, in blocks, and give a spanning forest of their links, not pairs.
Documents that still share a long list with another component and another star
are joined by the rarest values of their whole sets, in classes of size, which
loses no pair at the threshold and gives few others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import checkpointed, text_of, words_of
from pricelake.llm.components import components
from pricelake.llm.hashing import mixed, rolling, word_hashes

#: Values in a sketch.
SKETCH = 64
#: The longest list whose pairs are written out; longer ones are peeled, which finds the same links.
SHORT = 16
#: An estimate may fall short of the threshold by so much (six standard deviations of a sketch of 64).
SLACK = 0.3
#: Documents this similar to a pivot or more belong to its star.
NEAR = 0.5
#: Members, and strays, of a star that meet in one task.
BLOCK = 4096
#: Sizes of sets in one class differ by less than this factor.
CLASS = 1.05


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending (signed) order; empty without words."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, dtype=np.int64)
    hashes = word_hashes(words)
    found = rolling(hashes, width) if len(words) >= width else mixed(rolling(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(found.view(np.int64))


def _sets(docs: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """(id, n, same, sketch): the set's size, a 128-bit hash of it, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(x, width) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x[:SKETCH] for x in sets], pa.list_(pa.int64()))],
                    names=["id", "n", "same", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, same binary, sketch array<long>")


def _may_match(n_a: Column, n_b: Column, threshold: float) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n_a, n_b) >= F.lit(round(100 * threshold)) * F.greatest(n_a, n_b)


def _estimate(a: Column, b: Column) -> Column:
    """Jaccard estimate from the bottom-k sketch of the union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _whole_sets(docs: DataFrame, ids: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """(rep, set) of the documents in ids (rep), computed once."""

    @F.pandas_udf("array<long>")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, width) for x in texts])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), text_of(text_col).alias("text")).join(ids, "rep", "left_semi")
    return checkpointed(rows.select("rep", whole("text").alias("set")))


def _compared(pairs: DataFrame, sketches: DataFrame, sets: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """The pairs (a, b, star) that pass the estimate, compared on their full sets.

    sets(ids) gives whole sets.  Adds linked, and for b near a star's pivot a:
    delta, the values that just one of the two has.
    """
    sketch = sketches.select("rep", "sketch")
    near = checkpointed(
        pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        .where(_estimate(F.col("sketch_a"), F.col("sketch_b")) >= F.lit(threshold - SLACK))
        .select("a", "b", "star")
    )
    part = round(100 * threshold)

    @F.pandas_udf("linked boolean, delta array<long>")
    def compare(a: pd.Series, b: pd.Series, star: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, s in zip(a, b, star, strict=True):
            delta = np.setxor1d(x, y, assume_unique=True)
            either = (len(x) + len(y) + len(delta)) // 2
            both = either - len(delta)
            out.append((100 * both >= part * either, delta if s and both >= NEAR * either else None))
        return pd.DataFrame(out, columns=["linked", "delta"])

    whole = sets(near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep"))).distinct())
    found = near.join(whole.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(
        whole.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b"
    )
    return checkpointed(found.withColumn("seen", compare("set_a", "set_b", "star")).select("a", "b", "seen.*"))


def _ranked(owners: DataFrame) -> DataFrame:
    """owners (rep, n, ..., values) with values reduced to those that others have, too, the rarest first.

    Adds alone, how many of its values no other has, and central, the sum of how
    often the others occur.  Equally rare values come in the order of all values.
    """
    entries = owners.select("rep", F.explode("values").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    shared = entries.join(often, "value").groupBy("rep")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("ranked"), F.sum("often").alias("central"))
    sized = owners.withColumn("held", F.size("values")).drop("values").join(shared, "rep")
    return sized.select("*", (F.col("held") - F.size("ranked")).alias("alone"), F.col("ranked.value").alias("values")).drop("ranked")


def _retained(reps: DataFrame, threshold: float) -> DataFrame:
    """(key, rep, n, size, pivot, pivot_n): inverted lists, of two documents and more, of the rarest sketch values.

    Two sketches that share s of their k values at least share one of each one's
    k - s + 1 rarest, whatever the order, if it is the same for both.  Whole sets
    share the threshold's part; sketches all but five standard deviations of it,
    and so may a whole set with the sketch of a larger one.
    """
    part = round(100 * threshold) / 100
    size = F.size("sketch")
    least = F.when(size <= int(SKETCH * part), F.ceil(size * part - 1e-9)).otherwise(int(SKETCH * part - 5 * (SKETCH * part * (1 - part)) ** 0.5))
    ranked = _ranked(reps.select("rep", "n", (size - least + 1).cast("int").alias("take"), F.col("sketch").alias("values")))
    first = (F.col("take") - F.col("alone")).cast("int")
    entries = ranked.where(first > 0).select("rep", "n", "central", F.explode(F.slice("values", F.lit(1), first)).alias("key"))
    entries = checkpointed(entries)
    pivot = F.max_by(F.struct("rep", "n"), F.struct("central", -F.col("rep"))).alias("pivot")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), pivot).where("size > 1")
    return checkpointed(entries.join(sizes, "key").select("key", "rep", "n", "size", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")))


def _stars(seen: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, star, n, delta): documents near pivots, each with the pivot that the most are near to, of equals the least."""
    near = seen.where("delta is not null").select(F.col("b").alias("rep"), F.col("a").alias("star"), "delta")
    popular = near.groupBy("star").agg(F.count("*").alias("popular"))
    own = popular.select(F.col("star").alias("rep"), "star", F.array().cast("array<long>").alias("delta"))
    every = near.union(own).join(popular, "star")
    best = F.max_by(F.struct("star", "delta"), F.struct("popular", -F.col("star")))
    return checkpointed(every.groupBy("rep").agg(best.alias("of")).select("rep", "of.star", "of.delta").join(reps.select("rep", "n"), "rep"))


def _within_stars(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of each star's strays, which are not in its pivot's component, with its members.

    members: (rep, star, n, delta, component, star_component).  Two documents
    share half of what both have beside their differences from the pivot, and the
    differences that they have in common.  The links of a block are given as a
    spanning forest of its components.
    """
    part = round(100 * threshold)
    stray = F.col("component") != F.col("star_component")
    sizes = members.groupBy("star").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if(stray) / BLOCK).alias("stray_blocks"))
    sized = members.join(sizes.where("stray_blocks > 0"), "star")
    own = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    cells = ["star", "block", "stray_block"]
    columns = [*cells, "rep", "n", "component", "delta"]
    met = sized.withColumn("block", own("blocks")).withColumn("stray_block", every("stray_blocks")).select(*columns, F.lit(False).alias("asks"))
    strays = sized.where(stray).withColumn("stray_block", own("stray_blocks")).withColumn("block", every("blocks")).select(*columns, F.lit(True).alias("asks"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        met, strays = rows[~rows["asks"]], rows[rows["asks"]]
        reps, n, component = (met[c].to_numpy() for c in ("rep", "n", "component"))
        sizes = np.array([len(x) for x in met["delta"]])
        values, owner = np.concatenate([np.empty(0, np.int64), *met["delta"]]), np.repeat(np.arange(len(met)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        root: dict[int, int] = {}

        def of(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        out = []
        for rep, n_a, own, delta in zip(strays["rep"], strays["n"], strays["component"], strays["delta"], strict=True):
            low, high = np.searchsorted(values, delta, side="left"), np.searchsorted(values, delta, side="right")
            count = high - low
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            both = (n_a - len(delta) + n - sizes) / 2 + np.bincount(owner[at], minlength=len(reps))
            linked = np.flatnonzero((100 * both >= part * (n_a + n - both)) & (component != own))
            groups, first = np.unique(component[linked], return_index=True)
            for group, k in zip(groups.tolist(), linked[first].tolist(), strict=True):
                if of(group) != of(own):
                    root[of(group)] = of(own)
                    out.append((rep, reps[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.union(strays).groupBy(cells).applyInPandas(meet, "a long, b long")


def _across(unsettled: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components and stars that may be linked, by the rarest values of whole sets.

    unsettled: (rep, n, component, star, values).  Sets of x and y values at the
    threshold t share o = t / (1 + t) * (x + y) at least, and so one of the x - o
    + 1 rarest of one and of the y - o + 1 rarest of the other.  The smaller set
    lists what any larger one needs; the larger one asks each class of sizes for
    what it can share with that class.
    """
    part = round(100 * threshold)
    log = math.log(CLASS)
    least = lambda x, y: F.ceil(F.lit(part / (100 + part)) * (x + y) - 1e-6)
    class_of = lambda x: F.floor(F.log(x) / log + 1e-9).cast("int")
    ranked = checkpointed(_ranked(unsettled))
    n = F.col("n")
    first = lambda smaller: F.greatest(F.lit(0), n - least(n, smaller) + 1 - F.col("alone")).cast("int")
    kept = ["rep", "n", "component", "star"]
    listed = ranked.select(*kept, class_of(n).alias("class"), F.explode(F.slice("values", F.lit(1), first(n))).alias("value"))
    smallest = F.ceil(n * (part / 100) - 1e-6)
    asked = ranked.withColumn("class", F.explode(F.sequence(class_of(smallest), class_of(n))))
    bound = F.greatest(smallest, F.floor(F.pow(F.lit(CLASS), F.col("class")) * (1 - 1e-6)))
    asked = asked.select(*kept, "class", F.explode(F.slice("values", F.lit(1), first(F.least(n, bound)))).alias("value"))
    listed, asked = checkpointed(listed), checkpointed(asked)
    # Members of a list's main star do not meet each other.
    keys = ["value", "class"]
    stars = listed.select(*keys, "star").union(asked.select(*keys, "star")).groupBy(*keys, "star").agg(F.count("*").alias("members"))
    main = stars.groupBy(keys).agg(F.count("*").alias("stars"), F.max_by("star", F.struct("members", "star")).alias("main")).where("stars > 1")
    listed, asked = (x.join(main.drop("stars"), keys).withColumn("off", F.col("star") != F.col("main")).drop("main") for x in (listed, asked))
    asked = asked.select(*keys, "off", *(F.col(c).alias(f"{c}_a") for c in kept))
    other = F.when(n == F.col("n_a"), F.col("rep") < F.col("rep_a")).otherwise(n < F.col("n_a"))
    fits = (F.col("component") != F.col("component_a")) & (F.col("star") != F.col("star_a")) & other & _may_match(n, F.col("n_a"), threshold)
    met = listed.where("off").join(asked, keys).where(fits).select("rep", "rep_a")
    met = met.union(listed.where("not off").join(asked.where("off"), keys).where(fits).select("rep", "rep_a"))
    return met.select(F.col("rep_a").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the least doc_id linked with it, over any steps), kept.

    Texts are lower-cased (A-Z) and cut into words; a set holds the distinct runs
    of width words (fewer words: all of them as one run).  Two documents are
    linked if 100 * |both| >= 100 * threshold * |either|.  Without words a
    document is linked with nothing.  A null identifier is linked with nothing,
    its component and kept are null.  Rows that share an identifier are one
    document.  An empty table gives no rows.  A very long text is one set, held
    whole by the task that compares it.  Columns of docs other than the two named
    play no part, whatever their names.
    """
    rows = checkpointed(_sets(docs, width, text_col, id_col))
    full = rows.where("n > 0 and id is not null")
    equal = full.groupBy("same", "n").agg(F.min(F.struct("id", "sketch")).alias("least"))
    reps = checkpointed(equal.select(F.col("least.id").alias("rep"), "n", "same", F.col("least.sketch").alias("sketch")))
    no, yes = F.lit(False).alias("star"), F.lit(True).alias("star")

    # Inverted lists: pairs of short ones, pivots of long ones.
    lists = _retained(reps, threshold)
    short = lists.where(F.col("size") <= SHORT).select("key", "rep", "n")
    other = short.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"))
    few = short.join(other, "key").where((F.col("rep") < F.col("b")) & _may_match(F.col("n"), F.col("n_b"), threshold))
    long = lists.where(F.col("size") > SHORT)
    with_pivot = long.where((F.col("rep") != F.col("pivot")) & _may_match(F.col("n"), F.col("pivot_n"), threshold))
    pairs = few.select(F.col("rep").alias("a"), "b", no).union(with_pivot.select(F.col("pivot").alias("a"), F.col("rep").alias("b"), yes))
    pairs = pairs.groupBy("a", "b").agg(F.max("star").alias("star"))
    seen = _compared(pairs, reps, lambda ids: _whole_sets(docs, ids, width, text_col, id_col), threshold)
    links = seen.where("linked").select("a", "b")
    found = checkpointed(components(links))
    component = F.coalesce("component", "rep").alias("component")
    component_of = found.select(F.col("node").alias("rep"), "component")

    if not long.isEmpty():
        stars = _stars(seen, reps)
        of_star = component_of.select(F.col("rep").alias("star"), F.col("component").alias("star_component"))
        members = stars.join(component_of, "rep", "left").join(of_star, "star", "left")
        members = members.withColumns({"component": component, "star_component": F.coalesce("star_component", "star")})
        more = checkpointed(_within_stars(members, threshold))

        # Members of long lists with several components and several stars.
        stand = long.select("key", "rep", "n").join(component_of, "rep", "left").join(stars.select("rep", "star"), "rep", "left")
        stand = checkpointed(stand.select("key", "rep", "n", component, F.coalesce("star", "rep").alias("star")))
        spread = [f(c).alias(f"{k}_{c}") for c in ("component", "star") for k, f in (("low", F.min), ("high", F.max))]
        mixed = stand.groupBy("key").agg(*spread).where("low_component != high_component and low_star != high_star").select("key")
        unsettled = checkpointed(stand.join(mixed, "key").select("rep", "n", "component", "star").distinct())
        if not unsettled.isEmpty():
            whole = _whole_sets(docs, unsettled.select("rep"), width, text_col, id_col).groupBy("rep").agg(F.first("set").alias("set"))
            valued = unsettled.join(whole.withColumnRenamed("set", "values"), "rep")
            tried = seen.select("a", "b").union(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
            candidates = _across(valued, threshold).join(tried, ["a", "b"], "left_anti").select("a", "b", no)
            last = _compared(candidates, reps, lambda ids: whole, threshold)
            more = more.union(last.where("linked").select("a", "b"))
        if not more.isEmpty():
            found = checkpointed(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))

    # An identifier's rows may have different sets: they join what each is linked with.
    of_set = reps.select("same", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_set = of_set.select("same", "n", F.coalesce("component", "rep").alias("component"))
    return rows.join(of_set, ["same", "n"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that near_duplicates keeps (a null identifier stays), all columns unchanged."""
    gone = near_duplicates(docs, width, threshold, text_col, id_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")

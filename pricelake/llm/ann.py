"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced k-means over a bounded sample and sit in an
in-memory neighbour graph that every task searches.  Every vector goes to the
list of its nearest centroid, and a vector near a boundary to further lists too.
A query reads the lists whose centroid distance is within a ratio of the nearest,
then those near ones whose centroid is nearer than the last neighbour it found.
Where the lists hold too few vectors for an answer (an outlier has a list nearly
for itself), it is compared with all vectors, in blocks of queries.
Where the table is too large for the centroids that tasks can hold, a list that
outgrows its size gets centroids of its own, fitted on a bounded sample of it,
and so on: lists form a tree, whose depth grows with the logarithm of the table,
and a query descends from each list that it reads to the near ones below.  What
no centroid divides is dealt in parts, all of which are read; of equal vectors
only the few with the least identifiers can be among the nearest, and
equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.llm.common import checkpointed

#: Vectors for each centroid, the most centroids (they are broadcast), the sample they are fitted on.
LIST_SIZE, CENTROIDS_MOST, SAMPLE_MOST = 128, 4096, 32_768
#: A list of more vectors than this is divided, into so many lists at most and so often at most.
SPLIT_SIZE, BELOW_MOST, LEVELS_MOST = 2048, 512, 4
#: (Numbers of lists stay within 64 bits.)  Lists below a list that a query reads, and vectors of a list that meet in one task when it is divided.
BELOW_PROBES, DEALT = 12, 4096
#: A vector is copied to lists within this ratio of its nearest centroid's distance, to so many at most.
COPY_RATIO, COPIES = 1.1, 4
#: A query reads lists within this ratio, so many at most.
PROBE_RATIO, PROBES = 1.6, 48
#: Queries without enough candidates in their lists that are compared with all vectors at once (they are broadcast).
QUERY_BLOCK = 2048
#: Neighbours of a centroid in the graph, and the width of the search.
DEGREE = 24


@dataclass
class CentroidGraph:
    """Centroids, each linked with its nearest ones and with a few far ones."""

    centroids: np.ndarray
    links: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, seed: int = 3) -> CentroidGraph:
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        square = (centroids**2).sum(1)
        links = np.zeros((n, degree), dtype=np.int64)
        rng = np.random.default_rng(seed)
        for low in range(0, n, 512):
            part = centroids[low : low + 512]
            d = square[None, :] - 2 * part @ centroids.T
            d[np.arange(len(part)), np.arange(low, low + len(part))] = np.inf
            links[low : low + len(part)] = np.argsort(d, axis=1)[:, :degree]
        if degree == DEGREE:
            links[:, -4:] = rng.integers(0, n, (n, 4))
        return CentroidGraph(centroids, links)

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the numbers and distances of about its width nearest centroids, nearest first."""
        n, rows = len(self.centroids), len(x)
        width = min(width, n)
        start = np.unique(np.linspace(0, n - 1, min(n, max(16, width))).astype(np.int64))
        ids = np.broadcast_to(start, (rows, len(start))).copy()
        dist = ((x[:, None, :] - self.centroids[start][None]) ** 2).sum(2)
        done = np.zeros(ids.shape, dtype=bool)
        every = np.arange(rows)[:, None]
        for _ in range(4 * width + 8):
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = ids[every, order], dist[every, order], done[every, order]
            open_ = np.where(done, np.inf, dist)
            best = open_.argmin(1)
            live = np.isfinite(open_[np.arange(rows), best])
            if not live.any() or not self.links.shape[1]:
                break
            done[np.arange(rows), best] = True
            new = self.links[ids[np.arange(rows), best]]
            d = ((x[:, None, :] - self.centroids[new]) ** 2).sum(2)
            d[(new[:, :, None] == ids[:, None, :]).any(2) | ~live[:, None]] = np.inf
            again = np.sort(new, axis=1)
            if (again[:, 1:] == again[:, :-1]).any():
                for k in range(1, new.shape[1]):
                    d[(new[:, :k] == new[:, k : k + 1]).any(1), k] = np.inf
            ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1)
            done = np.concatenate([done, ~np.isfinite(d)], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return ids[every, order], np.sqrt(dist[every, order])


def balanced_kmeans(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of k-means in which crowded clusters push vectors away."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    push = np.zeros(k)
    for _ in range(rounds):
        owner = np.empty(len(sample), dtype=np.int64)
        spread = 0.0
        for low in range(0, len(sample), 4096):
            part = sample[low : low + 4096]
            d = (part**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * part @ centroids.T
            owner[low : low + 4096] = (d + push).argmin(1)
            spread = max(spread, float(np.median(d)))
        size = np.bincount(owner, minlength=k)
        push += 0.05 * spread * (size * k / len(sample) - 1).clip(-1, 3)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        full = size > 0
        centroids[full] = sums[full] / size[full, None]
        if (~full).any():
            centroids[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
    return centroids


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): vectors without null or non-finite components that are not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vec = F.col(vector_col).cast("array<double>")
    ok = F.forall(vec, good) & F.exists(vec, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).where(ok & F.col("vec_id").isNotNull())


#: Numbers of the first lists begin here; a list below another has its number times 1024 and its own place: none is another's.
_ROOT = 1 << 13


def _descended(rows: DataFrame, level: DataFrame, ratio: float, most: int) -> DataFrame:
    """rows (ids, vec, list) whose list is divided at this level, at the near lists below it; the others as they are.

    level: (list, size, body), the centroids below each divided list.  A list's
    rows are dealt to tasks in parts of some DEALT, each with the centroids.
    """
    divided = level.select("list", F.ceil(F.col("size") / DEALT).cast("int").alias("deals"))
    own = rows.join(divided, "list", "left")
    moved = own.where("deals is not null").withColumn("deal", F.pmod(F.xxhash64("ids"), "deals").cast("int")).select("list", "deal", "ids", "vec")
    held = level.select("list", "body", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / DEALT).cast("int") - 1)).alias("deal"))

    def down(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(held):
            vecs = np.stack(rows["vec"].to_list())
            below = np.frombuffer(held["body"].iloc[0]).reshape(-1, vecs.shape[1])
            for low in range(0, len(vecs), 512):
                part = vecs[low : low + 512]
                d = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (below**2).sum(1)[None] - 2 * part @ below.T))
                near = np.argsort(d, axis=1, kind="stable")[:, :most]
                dist = np.take_along_axis(d, near, 1)
                for i, (places, far) in enumerate(zip(near, dist <= dist[:, :1] * ratio + 1e-12, strict=True), low):
                    out += [(rows["ids"].iloc[i], rows["vec"].iloc[i], int(rows["list"].iloc[i]) << 10 | int(x)) for x in places[far]]
        return pd.DataFrame(out, columns=["ids", "vec", "list"])

    below = moved.groupBy("list", "deal").cogroup(held.groupBy("list", "deal")).applyInPandas(down, "ids array<long>, vec array<double>, list long")
    return own.where("deals is null").select("ids", "vec", "list").union(below)


def _divided(posted: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """posted with its large lists divided, the centroids of each level, and (list, parts): in how many parts a list is dealt."""
    levels: list[DataFrame] = []
    while True:
        sizes = checkpointed(posted.groupBy("list").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > SPLIT_SIZE)
        if len(levels) == LEVELS_MOST or large.isEmpty():
            return posted, levels, sizes.select("list", F.ceil(F.col("size") / SPLIT_SIZE).cast("int").alias("parts"))
        want = F.least(F.lit(BELOW_MOST), F.ceil(F.col("size") / LIST_SIZE)).cast("int")
        drawn = posted.join(large.withColumn("want", want), "list").where(F.pmod(F.xxhash64("ids", F.lit(len(levels))), "size") < 8 * F.col("want"))

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            """A list's centroids, from eight vectors for each."""
            sample = np.stack(rows["vec"].to_list())
            below = balanced_kmeans(sample, min(int(rows["want"].iloc[0]), len(sample)))
            return pd.DataFrame({"list": rows["list"][:1], "size": rows["size"][:1], "body": [np.unique(below, axis=0).tobytes()]})

        level = checkpointed(drawn.select("list", "size", "want", "vec").groupBy("list").applyInPandas(fit, "list long, size long, body binary"))
        # A list that its centroids leave whole is not divided again: it is dealt in parts.
        moved = checkpointed(_descended(posted, level, COPY_RATIO, 2))
        whole = moved.where(F.col("list") >= F.lit(_ROOT << 10 * (len(levels) + 1))).groupBy("list").agg(F.count("*").alias("n")).withColumn("above", F.shiftright("list", 10))
        stuck = whole.join(level.select(F.col("list").alias("above"), "size"), "above").where(F.col("n") > 0.9 * F.col("size")).select(F.col("above").alias("list")).distinct()
        if not stuck.isEmpty():
            level = checkpointed(level.join(stuck, "list", "left_anti"))
            if level.isEmpty():
                return posted, levels, sizes.select("list", F.ceil(F.col("size") / SPLIT_SIZE).cast("int").alias("parts"))
            moved = checkpointed(_descended(posted, level, COPY_RATIO, 2))
        posted = moved
        levels.append(level)


def nearest_neighbours(
    vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each row that is_query (SQL over vec_id) holds for: query_id, rank, vec_id, score (Euclidean distance).

    Its k nearest other rows, ties to the smaller vec_id; all of them if fewer.
    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components, and rows without identifier, take no part.  Rows that
    share an identifier are one if their vectors are equal.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    rows = checkpointed(rows.where(F.size("vec") == (width.w if width else 0)).distinct())
    of_equal = Window.partitionBy("vec").orderBy("vec_id")
    distinct = rows.withColumn("rn", F.row_number().over(of_equal)).where(F.col("rn") <= k + 1)
    distinct = checkpointed(distinct.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = distinct.count()
    result = "qkey long, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    taken = distinct.select("vec").sample(fraction=min(1.0, SAMPLE_MOST / n), seed=11).limit(2 * SAMPLE_MOST).collect()
    sample = np.array([r.vec for r in taken]) if taken else np.array([distinct.first().vec])
    graph = CentroidGraph.of(balanced_kmeans(sample, max(1, min(n // LIST_SIZE, CENTROIDS_MOST, len(sample)))))
    shared = spark.sparkContext.broadcast(graph)  # CENTROIDS_MOST centroids and their links at most

    def lists(most: int):
        """The nearest lists, nearest first."""

        @F.pandas_udf("array<struct<list:long,dist:double>>")
        def near(vecs: pd.Series) -> pd.Series:
            out = []
            for low in range(0, len(vecs), 512):
                ids, dist = shared.value.nearest(np.stack(vecs.iloc[low : low + 512].to_list()), max(most, 16))
                out += [[{"list": _ROOT + x, "dist": y} for x, y in zip(i, d, strict=True)] for i, d in zip(ids[:, :most].tolist(), dist[:, :most].tolist(), strict=True)]
            return pd.Series(out)

        return near("vec")

    def within(ratio: float) -> Column:
        bound = F.col("near")[0]["dist"] * ratio + 1e-12
        return F.transform(F.filter("near", lambda x: x["dist"] <= bound), lambda x: x["list"])

    posted = checkpointed(distinct.select("ids", "vec", lists(COPIES).alias("near")).select("ids", "vec", F.explode(within(COPY_RATIO)).alias("list")))
    posted, levels, parts = _divided(posted)
    candidates = posted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("ids"), "parts").cast("int")).drop("parts")

    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    searched = queries.groupBy("vec").agg(F.min("query_id").alias("qkey"))
    searched = checkpointed(searched.select("qkey", "vec", lists(PROBES).alias("near")))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(q) and len(c):
            vecs, ids = np.stack(c["vec"].to_list()), c["ids"].to_list()
            first = np.array([x[0] for x in ids])
            for key, vec in zip(q["qkey"], q["asked"], strict=True):
                rough = ((vecs - vec) ** 2).sum(1)
                cut = np.partition(rough, min(k, len(rough) - 1))[min(k, len(rough) - 1)]
                near = np.flatnonzero(rough <= cut * (1 + 1e-9))
                # A sum in the order of the components: the same wherever a vector is compared, and that of a plain loop.
                d = np.sqrt(np.cumsum((vecs[near] - vec) ** 2, axis=1)[:, -1])
                found = [(key, i, d[x]) for x in np.lexsort((first[near], d)) for i in ids[near[x]]]
                out += sorted(found, key=lambda r: (r[2], r[1]))[: k + 1]
        return pd.DataFrame(out, columns=["qkey", "vec_id", "score"])

    best = Window.partitionBy("qkey").orderBy("score", "vec_id")

    def best_of(hits: DataFrame) -> DataFrame:
        return checkpointed(hits.distinct().withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn"))

    def found_in(asked: DataFrame) -> DataFrame:
        """Hits of the queries (qkey, vec, list) in those lists."""
        for level in levels:
            asked = _descended(asked.select(F.array("qkey").alias("ids"), "vec", "list"), level, PROBE_RATIO, BELOW_PROBES).select(F.col("ids")[0].alias("qkey"), "vec", "list")
        asked = asked.join(parts, "list")
        asked = asked.select("qkey", F.col("vec").alias("asked"), "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return asked.groupBy("list", "part").cogroup(candidates.groupBy("list", "part")).applyInPandas(search, result)

    def found_in_all(block: tuple) -> DataFrame:
        """Hits of a block of queries among all vectors."""
        asked = spark.sparkContext.broadcast(([r.qkey for r in block], [np.array(r.vec) for r in block]))  # QUERY_BLOCK queries at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = pd.DataFrame(dict(zip(("qkey", "asked"), asked.value, strict=True)))
            held = pd.DataFrame(columns=["qkey", "vec_id", "score"])
            for c in batches:
                new = search(q, c)
                held = pd.concat([held, new]).sort_values(["score", "vec_id"]).groupby("qkey").head(k + 1) if len(held) else new
            yield held

        return distinct.select("ids", "vec").mapInPandas(run, result)

    hits = best_of(found_in(searched.select("qkey", "vec", F.explode(within(PROBE_RATIO)).alias("list"))))
    # The last neighbour found (the query itself is a hit, too) bounds what further lists can add.
    state = searched.join(hits.groupBy("qkey").agg(F.count("*").alias("n"), F.max("score").alias("last")), "qkey", "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) > k
    bound = F.col("near")[0]["dist"] * PROBE_RATIO + 1e-12
    further = F.filter("near", lambda x: (x["dist"] > bound) & (x["dist"] < F.col("last")))
    unread = state.where(enough).select("qkey", "vec", F.explode(further).alias("one"))
    unread = checkpointed(unread.select("qkey", "vec", F.col("one.list").alias("list")))
    if not unread.isEmpty():
        hits = best_of(hits.union(found_in(unread)))
    for block in batched(state.where(~enough).select("qkey", "vec").toLocalIterator(), QUERY_BLOCK):
        hits = best_of(hits.union(found_in_all(block)))
    own = queries.join(searched, "vec").select("query_id", "qkey")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = own.join(hits, "qkey").where("query_id != vec_id").withColumn("rank", F.row_number().over(order).cast("int"))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

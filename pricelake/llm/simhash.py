"""Near duplicates by SimHash fingerprints and a generalised pigeonhole.

A fingerprint's bit is set if it is set in over half of the hashes of a text's
shingles.  Two fingerprints that differ in at most d bits differ, for any split
of the bits into m partitions and any thresholds that sum to d - m + 1, by at most
the threshold in one of the partitions (a threshold of -1 leaves a partition
out).  So bits that go together are put into one partition, and dynamic
programming gives the partitions unequal thresholds, by how many candidates each
would yield.  What is estimated (bits that go together, candidates) is estimated
from sketches that all fingerprints enter.  Every fingerprint is listed by its
bits in a partition, and probes that list, and where the threshold is 1 also those
one bit off; candidates are verified on all bits.

Sizes: equal fingerprints are one from the start.  A short list gives its pairs.
The members of long lists (large groups of near copies, partitions with few
values) are put together by the fingerprints at most one bit from them: two that
differ in two bits share one such neighbour, and a neighbour has at most 65
members, however large the group is.  Both find the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import checkpointed, text_of
from pricelake.llm.components import components
from pricelake.llm.hashing import mixed

BITS = 64
#: Seed of the shingles' XXH64.
SEED = 42
#: Bytes of a text that are split into words at a time.
STRETCH = 1 << 20
#: The longest list whose pairs are written out.
SHORT = 64
#: Fingerprints that a task sums up.
TASK = 1 << 16
#: Counters of a sketch of the second moment: its error is some 4 per cent.
COUNTERS = 1024
#: A-Z in lower case, the six ASCII blanks as one of them.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _stretches(text: str | None, width: int) -> Iterator[list[bytes]]:
    """A text's words in lower case, a stretch at a time, each led by the width - 1 words before it."""
    raw, low, last = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), 0, []
    while low < len(raw):
        high = raw.find(b" ", low + STRETCH)
        high = len(raw) if high < 0 else high
        words = [*last, *raw[low:high].split()]
        yield words
        low, last = high, words[len(words) - width + 1 :] if width > 1 and len(words) >= width else words if width > 1 else []


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """The XXH64 of every run of width words (all words if there are fewer), joined by a space."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """A text's fingerprint, unsigned; 0 without words."""
    ones, n, few = np.zeros(BITS, dtype=np.int64), 0, []
    for words in _stretches(text, width):
        if len(words) < width:
            few = words
            continue
        few = []
        got = _hashes(words, width)
        ones += np.unpackbits(got.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(got)
    if few and not n:
        return int(_hashes(few, width)[0])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(docs: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x.as_py(), width) for x in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def _summed(values: DataFrame, counted) -> np.ndarray:
    """The sum over all batches of what counted gives for an array of fingerprints; its size is fixed.

    A task takes some TASK fingerprints, so that partial sums are not more than a few rows a fingerprint.
    """
    values = values.coalesce(math.ceil(max(1, values.count()) / TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            got = counted(batch.column(0).to_numpy().view(np.uint64))
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = values.select("bits").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n != 0").collect()
    out = np.zeros(len(counted(np.zeros(0, dtype=np.uint64))), dtype=np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def _together(bits: np.ndarray) -> np.ndarray:
    """How often both of two bits are set (64 x 64), and last how many fingerprints there are."""
    x = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    return np.append((x.T @ x).round().astype(np.int64).reshape(-1), len(bits))


def correlations(values: DataFrame) -> tuple[np.ndarray, int]:
    """|phi| of every two bits over all fingerprints, and how many there are; bits that never change go together."""
    got = _summed(values, _together)
    n, both = int(got[-1]), got[:-1].reshape(BITS, BITS)
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    still = spread == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    phi[np.logical_or.outer(still, still)] = 0
    phi[np.logical_and.outer(still, still)] = 1
    return phi, n


def grouped_bits(phi: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of about equal size, correlated ones together."""
    free, out = set(range(BITS)), []
    for left in range(m, 0, -1):
        size = math.ceil(len(free) / left)
        part = [max(sorted(free), key=lambda b: sum(phi[b, c] for c in free if c != b))]
        while len(part) < size:
            part.append(max(sorted(free - set(part)), key=lambda b: sum(phi[b, c] for c in part)))
        free -= set(part)
        out.append(sorted(part))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def moments(values: DataFrame, masks: list[int]) -> list[float]:
    """For each mask the sum over all masked values of their squared frequency, from sketches of random signs."""
    each = np.array(masks, dtype=np.uint64)

    def sketch(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(each), COUNTERS), dtype=np.int64)
        for i, mask in enumerate(each):
            h = mixed((bits & mask) ^ mixed(np.array([i + 1], dtype=np.uint64)))
            at, sign = (h % np.uint64(COUNTERS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)
            out[i] = np.bincount(at, weights=sign, minlength=COUNTERS).astype(np.int64)
        return out.reshape(-1)

    return (_summed(values, sketch).reshape(len(each), COUNTERS).astype(np.float64) ** 2).sum(axis=1).tolist()


def allocated(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """One threshold for each partition, with the given sum and the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in cost.items():
                if s + t not in now or c + more < now[s + t][0]:
                    now[s + t] = (c + more, [*chosen, t])
        best = now
    return best.get(total, (math.inf, []))


def plan(values: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The partitions (bits, threshold) that are to be probed; values: distinct fingerprints, in a column named bits."""
    phi, n = correlations(values)
    ways = [grouped_bits(phi, m) for m in range(max(2, math.ceil((distance + 1) / 2)), distance + 3)]
    masks = [_mask(p) for way in ways for p in way] + [_mask([c for c in p if c != b]) for way in ways for p in way for b in p]
    moment = dict(zip(masks, moments(values, masks), strict=True))
    best = (math.inf, [])
    for way in ways:
        costs = []
        for p in way:
            same = moment[_mask(p)]
            # Without one bit, values that differ in it fall together: what that adds are the pairs one bit apart.
            off = sum(max(0.0, moment[_mask([c for c in p if c != b])] - same) for b in p)
            equal = max(0.0, same - n) / 2
            costs.append({-1: 0.0, 0: n + equal, 1: n * (1 + len(p)) + equal + off})
        cost, thresholds = allocated(costs, distance - len(way) + 1)
        best = min(best, (cost, [(p, t) for p, t in zip(way, thresholds, strict=False) if t >= 0]), key=lambda x: x[0])
    return best[1]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _listed(values: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(bits, part, value, home): the lists that a fingerprint is in, and those that it only probes."""
    entries = []
    for i, (part, threshold) in enumerate(partitions):
        own = F.col("bits").bitwiseAND(_signed(_mask(part)))
        near = [own, *(own.bitwiseXOR(_signed(1 << b)) for b in part)] if threshold else [own]
        entries += [F.struct(F.lit(i).alias("part"), v.alias("value"), F.lit(k == 0).alias("home")) for k, v in enumerate(near)]
    return values.select("bits", F.inline(F.array(*entries)))


def links(values: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints (a column named bits) at most so many bits apart, 2 at most.

    Within long lists of distance 2, members of one neighbour are linked with the least of them.
    """
    if distance not in (1, 2):
        raise ValueError("fingerprints are linked at a distance of 1 or 2 bits")
    listed = _listed(values, plan(values, distance))
    sizes = listed.groupBy("part", "value").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("size > 1 AND homes > 0")
    listed = checkpointed(listed.join(sizes.drop("homes"), ["part", "value"]))
    short = listed.where(F.col("size") <= SHORT).drop("size")
    other = short.select("part", "value", F.col("bits").alias("b"), F.col("home").alias("home_b"))
    once = (F.col("bits") < F.col("b")) | ~F.col("home_b")
    close = F.bit_count(F.col("bits").bitwiseXOR(F.col("b"))) <= distance
    few = short.where("home").join(other, ["part", "value"]).where(once & close & (F.col("bits") != F.col("b"))).select(F.col("bits").alias("a"), "b")

    many = listed.where(F.col("size") > SHORT).select("bits").distinct()
    near = F.array(F.col("bits"), *(F.col("bits").bitwiseXOR(_signed(1 << b)) for b in range(BITS)))
    met = many.select("bits", F.explode(near).alias("near")).groupBy("near").agg(F.collect_list("bits").alias("members")).where(F.size("members") > 1)
    least = F.array_min("members") if distance == 2 else F.when(F.array_contains("members", F.col("near")), F.col("near"))
    stars = met.select(least.alias("a"), F.explode("members").alias("b")).where("a != b")
    return few.union(stars).distinct()


def simhash_components(docs: DataFrame, width: int = 3, distance: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id: the least doc_id linked with it, over any steps.

    Texts are lower-cased (A-Z) and cut into words; repeated shingles count
    again; a text of fewer than width words is one shingle.  Null texts, empty
    ones and those without words have the fingerprint zero and are linked like
    any other.  Rows of one identifier are each linked by their own text.  A null
    identifier is linked too, but is never the least: a component of such rows
    alone has a null component_id.  An empty table gives no rows.  Texts are read
    whole, a stretch at a time.  Other columns play no part, whatever their names.
    """
    rows = checkpointed(_fingerprints(docs, width, text_col, id_col))
    values = checkpointed(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    found = checkpointed(components(links(values.select("bits"), distance))).withColumnRenamed("node", "bits")
    named = values.join(found, "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    of_component = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_value = checkpointed(named.join(of_component, "component").select("bits", "component_id"))
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return rows.join(of_value, "bits").select("doc_id", digits.alias("fingerprint"), "component_id")

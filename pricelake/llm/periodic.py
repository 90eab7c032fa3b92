"""Runs of repeated words: online dyadic square catching.

Words are appended to a stream, a stretch at a time.  Each completed block of a
power of two of words has a catcher: it waits for the block's words to come again
one to two block lengths later, by rolling hashes of windows of that length, which
for a whole stretch are compared at once.  What it catches is a square or the
beginning of one: comparing the words before and after the two places, suffix by
suffix, tells how far the period reaches.  Squares of one period that overlap are
one run; a run that reaches the end of the stream stays open and grows with the
next words.  A run repeats its words four times at least, so it holds a whole
block not longer than its period and two more copies of it: nothing is missed,
and what is no run is mostly sorted out by the third copy's hash.

A square inside a run of a smaller period is a multiple of that period, and is
passed over.  Words are compared as numbers of an exact vocabulary, so a hash can
cost time but not a result.

Sizes: short documents share a stream, each closed by a word that no text has; a
long one has a stream of its own.  A stream takes some 60 bytes a word; the work
grows with n log n for a document of n words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import text_of
from pricelake.llm.hashing import _up_to, mixed

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4
#: Words that short documents share a stream for, and the longest stretch appended at once.
SHARED = 1 << 16
#: Bytes of a text that are split into words at a time.
STRETCH = 1 << 20
#: The six ASCII blanks as one of them.
_PLAIN = bytes(32 if 9 <= b <= 13 else b for b in range(256))


class Catchers:
    """The runs (start, length, period) of a stream of numbers."""

    def __init__(self, least: int = LEAST, times: int = TIMES) -> None:
        self.least, self.times, self.n = least, times, 0
        self.words, self.sums = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.uint64)
        self.compared: list[int] = []  # of each level, the windows that its catchers have seen
        self.reached: dict[int, tuple[int, int]] = {}  # period -> the last stretch (start, end) known to have it
        self.runs: list[tuple[int, int, int]] = []  # (start, end, period) of closed stretches with a period

    def append(self, stretch: np.ndarray, longest: int) -> None:
        """longest: words of the longest document so far, which bounds the periods."""
        before, self.n = self.n, self.n + len(stretch)
        if self.n > len(self.words):
            size = max(self.n, 2 * len(self.words) if before else self.n)
            self.words, self.sums = np.resize(self.words, size), np.resize(self.sums, size + 1)
        self.words[before : self.n] = stretch
        powers, _ = _up_to(self.n)
        hashes = mixed(stretch.astype(np.uint64)) * powers[before:]
        self.sums[0] = 0
        self.sums[before + 1 : self.n + 1] = self.sums[before] + np.cumsum(hashes, dtype=np.uint64)
        self._grow(before)
        self._catch(longest, last=False)

    def finish(self, longest: int) -> np.ndarray:
        """All runs, one in a row, by start, then period."""
        self._catch(longest, last=True)
        for period, (start, end) in self.reached.items():
            self.runs.append((start, end, period))
        self.reached = {}
        got = {(s, e - s, p) for s, e, p in self.runs if e - s >= max(self.least, self.times * p)}
        return np.array(sorted(got, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)

    def _grow(self, before: int) -> None:
        """Stretches that reached the end go on with the words appended since."""
        for period, (start, end) in list(self.reached.items()):
            if end == before:
                self.reached[period] = (start, self._forward(end - period, period))

    def _forward(self, at: int, period: int) -> int:
        """The end of the stretch in which words are as one period before, from a place where they are."""
        step = 64
        while at + period < self.n:
            high = min(at + step, self.n - period)
            off = self.words[at:high] != self.words[at + period : high + period]
            if off.any():
                return at + int(off.argmax()) + period
            at, step = high, 2 * step
        return self.n

    def _back(self, at: int, period: int) -> int:
        """The start of that stretch."""
        step = 64
        while at > 0:
            low = max(0, at - step)
            off = self.words[low:at] != self.words[low + period : at + period]
            if off.any():
                return at - int(off[::-1].argmax())
            at, step = low, 2 * step
        return 0

    def _windows(self, size: int, low: int, high: int) -> np.ndarray:
        """The hashes of the windows of a size that start from low up to high."""
        _, inverses = _up_to(self.n)
        return (self.sums[low + size : high + size] - self.sums[low:high]) * inverses[low:high]

    def _catch(self, longest: int, last: bool) -> None:
        level = 0
        while self.times << level <= longest:
            size = 1 << level
            if level == len(self.compared):
                self.compared.append(size)
            low, high = self.compared[level], self.n - (2 * size if last else 3 * size) + 1
            if high > low:
                self._compare(size, low, high)
                self.compared[level] = high
            level += 1

    def _compare(self, size: int, low: int, high: int) -> None:
        """Catchers of blocks of a size meet the windows from low up to high, one to two blocks on."""
        base = (low // size - 1) * size
        hashes = self._windows(size, base, self.n - size + 1)
        at = np.arange(low, high)
        block = (at // size - 1) * size
        caught = np.flatnonzero(hashes[low - base : high - base] == hashes[block - base])
        if not len(caught):
            return
        block, period = block[caught], at[caught] - block[caught]
        third = block + 2 * period
        fits = third + size <= self.n
        block, period, third = block[fits], period[fits], third[fits]
        same = hashes[third - base] == hashes[block - base]
        block, period, third = block[same], period[same], third[same]
        within = self._reach(size, block) >= block + period + size
        for start, p in zip(block[~within].tolist(), period[~within].tolist(), strict=True):
            known = self.reached.get(p)
            if known and known[0] <= start < known[1] - p:
                continue
            if not np.array_equal(self.words[start : start + size], self.words[start + p : start + p + size]):
                continue
            if known:
                self.runs.append((*known, p))
            self.reached[p] = (self._back(start, p), self._forward(start, p))

    def _reach(self, size: int, places: np.ndarray) -> np.ndarray:
        """How far a stretch of a period below size goes that begins at a place or before it."""
        small = [(s, e) for s, e, p in self.runs if p < size] + [(s, e) for p, (s, e) in self.reached.items() if p < size]
        if not small or not len(places):
            return np.full(len(places), -1)
        starts, ends = np.array(sorted(small)).T
        at = np.searchsorted(starts, places, side="right") - 1
        return np.where(at >= 0, np.maximum.accumulate(ends)[at], -1)


class _Vocabulary(dict):
    """word -> number, exact; words: the words in order of their numbers."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words, as numbers, split a stretch at a time."""
        raw, low, out = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), 0, []
        while low < len(raw):
            high = raw.find(b" ", low + STRETCH)
            high = len(raw) if high < 0 else high
            words = raw[low:high].split()
            out.append(np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words)))
            low = high
        return np.concatenate(out) if out else np.empty(0, dtype=np.int32)

    def text(self, numbers: np.ndarray) -> str:
        of = self.words.__getitem__
        return b" ".join(b" ".join(map(of, numbers[i : i + SHARED].tolist())) for i in range(0, len(numbers), SHARED)).decode("utf-8", "surrogatepass")


def _runs_of(documents: list[np.ndarray], least: int, times: int) -> list[np.ndarray]:
    """The runs of each document; all go through one stream."""
    catchers, waiting, waits, longest, starts, at = Catchers(least, times), [], 0, 0, [], 0
    for k, numbers in enumerate(documents):
        starts.append(at)
        at += len(numbers) + 1
        for low in range(0, len(numbers), SHARED):
            part = numbers[low : low + SHARED]
            waiting.append(part.astype(np.int64))
            waits, longest = waits + len(part), max(longest, low + len(part))
            if waits >= SHARED:
                catchers.append(np.concatenate(waiting), longest)
                waiting, waits = [], 0
        waiting.append(np.array([-1 - k], dtype=np.int64))
    catchers.append(np.concatenate(waiting), longest)
    runs = catchers.finish(longest)
    whose = np.searchsorted(starts, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(whose, np.arange(len(documents) + 1))
    return [runs[a:b] - np.array([s, 0, 0]) for a, b, s in zip(cuts, cuts[1:], starts, strict=False)]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"


def repeated_runs(
    docs: DataFrame, derive: Callable[[int | None, np.ndarray], np.ndarray] | None = None, least: int = LEAST, times: int = TIMES, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """For each row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words with a smallest period (words a period apart are
    the same), at least max(least, times * period) words long, that can't be made
    longer.  times: 4 at least.  collapsed holds the words that no run contains
    after its first period, joined by one space.  derive(doc_id, numbers) may give
    other words in place of a document's (numbers: its words in its order, as
    numbers; the result: numbers among them).

    A null text counts as empty: no words, no runs, an empty collapsed text.  A
    null identifier stays null.  Repeated rows are each done.  An empty table gives
    no rows.  A word's length plays no part.  Other columns play no part,
    whatever their names.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not caught")

    def done(rows: list[tuple], vocabulary: _Vocabulary) -> pa.RecordBatch:
        numbers = [r[1] for r in rows]
        runs = _runs_of(numbers, least, times)
        texts = [vocabulary.text(w[_kept(len(w), r)] if len(r) else w) for w, r in zip(numbers, runs, strict=True)]
        flat = np.concatenate(runs)
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(w) for w in numbers], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), struct), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, vocabulary = [], 0, _Vocabulary()
        for batch in batches:
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                numbers = vocabulary.numbers(text.as_py())
                numbers = derive(ident, numbers) if derive else numbers
                rows.append((ident, numbers))
                held += len(numbers) + 1
                if held >= SHARED:
                    yield done(rows, vocabulary)
                    rows, held, vocabulary = [], 0, _Vocabulary()
        if rows:
            yield done(rows, vocabulary)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def planted(ident: int | None, numbers: np.ndarray) -> np.ndarray:
    """A tenth of the documents, by a hash of their identifier, repeat a stretch of their words up to the end."""
    n = len(numbers)
    if ident is None or not n:
        return numbers
    h = zlib.crc32(str(ident).encode())
    if h % 10:
        return numbers
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return numbers[np.where(i >= a, a + (i - a) % p, i)]


def run_digests(found: DataFrame) -> DataFrame:
    """Of repeated_runs(): each row's number of runs, the run repeated most, and the digests of all runs and of the collapsed text.

    Most: the greatest length / period; ties to the smaller start, then period.
    """

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        by_place = F.when((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"]), -1).otherwise(1)
        return F.when(x > y, -1).when(x < y, 1).otherwise(by_place)

    most = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select("doc_id", "runs", "collapsed", most.alias("most")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("most")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Language-model scores: a log-bilinear neural model over word classes.

The model predicts the class of the next token from the two before it: the
context's vectors, each through its own matrix, add up to a predicted vector
whose products with the classes' output vectors, plus a bias, are the scores.
The most frequent words are classes of their own, more of them the more text
there is, up to a bound; all others are classed by how often the corpus has them,
a class for each power of two, in which a word has its smoothed share.  Training
is noise-contrastive, in numpy, on all training tokens: every task trains on its
own partition from the same start and the results are averaged, weighted by
tokens.  Scores are normalised over all classes by batched matrix products, each
distinct context once.

Texts are read and hashed once, as packed chunks.  Word counts are exact and
cover the corpus: chunks ask buckets of the hash space for the counts of their
distinct words, so no vocabulary is broadcast or collected; only the classes and
totals reach the driver, merged on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import checkpointed, partitions, text_of, words_of
from pricelake.llm.hashing import mixed, word_hashes

#: Words with a class of their own: the most frequent, as many as the training tokens to this power, and so many at most.
CLASSES_POWER, CLASSES = 0.47, 1022
#: The size of a vector, noise samples a batch and their weight.
SIZE, NOISE, NOISE_RATIO = 24, 96, 12.0
#: Tokens a training batch, the learning rate, rounds of training and averaging.
BATCH, RATE, ROUNDS = 4096, 0.08, 2
#: Tokens at which a chunk of documents ends.
CHUNK_TOKENS = 1 << 20
#: Powers of two that a count can lie between.
BINS = 63
#: The end token; no word is empty.
END = b""
_PAIR = np.dtype([("h", "<u8"), ("n", "<i8")])
#: Parts in which models are averaged, and groups of tasks that are merged first.
_PARTS, _GROUPS = 8, 64
#: A packed row: a chunk's documents (bucket -1), or what it has in a bucket.
_PACKED = "chunk long, bucket int, body binary"
_DOCS = np.dtype([("id", "<i8"), ("has_id", "?"), ("held_out", "?"), ("n", "<i8")])


def hashes_of(text: str | None) -> np.ndarray:
    """The tokens of a text, the end token last, as hashes."""
    return word_hashes([*words_of(text, lower=True), END])


def held_out(ident: Column) -> Column:
    """Documents that the model does not learn from; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h) % np.uint64(n)).astype(np.int64)


def _pairs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), dtype=_PAIR)
    out["h"], out["n"] = h, n
    return out


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk", "bucket", "body"])


def bins_of(counts: np.ndarray) -> np.ndarray:
    """The power of two below each count; words never seen stand with those seen once."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


@dataclass
class Vocabulary:
    """Classes: first a bin for each power of two of the counts of words without a class of their own, then such words.

    One more class stands before a text.
    """

    words: np.ndarray  # hashes of words with a class of their own, ascending
    counts: np.ndarray  # of those words
    bin_tokens: np.ndarray  # of all other words, by bin
    bin_words: np.ndarray

    @property
    def bins(self) -> int:
        """Bins up to the last one with a word; at least one, for words never seen."""
        used = np.flatnonzero(self.bin_words)
        return int(used[-1]) + 1 if len(used) else 1

    @property
    def size(self) -> int:
        return self.bins + len(self.words)

    @property
    def tokens(self) -> int:
        return int(self.bin_tokens.sum() + self.counts.sum())

    @property
    def distinct(self) -> int:
        return int(self.bin_words.sum()) + len(self.words)

    @property
    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.bin_tokens[: self.bins], self.counts])

    def classes(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rest = np.minimum(bins_of(counts), self.bins - 1)
        if not len(self.words):
            return rest
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.bins + at, rest)

    def share_log10(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The share of a word in its class, add-one smoothed; the first bin keeps the share of one more for words never seen."""
        rest = np.minimum(classes, self.bins - 1)
        whole = self.bin_tokens[rest] + self.bin_words[rest] + (rest == 0)
        return np.where(classes < self.bins, np.log10((counts + 1) / np.maximum(whole, 1)), 0.0)

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.distinct + 1)))


def _chunks(docs: DataFrame, text_col: str, id_col: str, buckets: int) -> DataFrame:
    """Packed rows of chunks: their documents, tokens as places among the chunk's distinct words, and those words by bucket.

    A word's row holds its hash and how often the chunk's training texts have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        about: list[tuple] = []
        tokens: list[np.ndarray] = []

        def chunk() -> pa.RecordBatch:
            nonlocal done
            number, done = task << 32 | done, done + 1
            docs = np.array(about, dtype=_DOCS)
            h, place = np.unique(np.concatenate(tokens), return_inverse=True)
            use = np.repeat(~docs["held_out"], docs["n"])
            count = np.bincount(place[use], minlength=len(h))
            body = pa.compress(docs.tobytes() + place.astype("<u4").tobytes(), codec="zstd", asbytes=True)
            head = np.array([len(docs), docs.nbytes + 4 * len(place)], dtype="<i8").tobytes()
            bucket = _bucket(h, buckets)
            order = np.argsort(bucket, kind="stable")
            asked, ends = _pairs(h[order], count[order]), np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
            rows = [(number, b, asked[low:high].tobytes()) for b, (low, high) in enumerate(zip([0, *ends], ends, strict=False)) if high > low]
            about.clear()
            tokens.clear()
            return _packed([(number, -1, head + body), *rows])

        held = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                columns = (part.column(c).to_pylist() for c in ("id", "held_out", "text"))
                for ident, out, text in zip(*columns, strict=True):
                    tokens.append(hashes_of(text))
                    about.append((ident or 0, ident is not None, out, len(tokens[-1])))
                    held += len(tokens[-1])
                    if held >= CHUNK_TOKENS:
                        yield chunk()
                        held = 0
        if about:
            yield chunk()

    ident = F.col(id_col)
    rows = docs.select(ident.cast("long").alias("id"), held_out(ident).alias("held_out"), text_of(text_col).alias("text"))
    return checkpointed(rows.mapInArrow(run, _PACKED))


def _documents(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's documents and the places of their tokens."""
    n, size = np.frombuffer(body[:16], "<i8").tolist()
    raw = pa.decompress(body[16:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, _DOCS, count=n), np.frombuffer(raw, "<u4", offset=n * _DOCS.itemsize)


def _counted(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each bucket of the chunks' words: what each chunk asked with the counts over all chunks; and a row of totals (chunk -1)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, bodies = [], []
        for batch in batches:
            whose += batch.column("chunk").to_pylist()
            bodies += [np.frombuffer(x, _PAIR) for x in batch.column("body").to_pylist()]
            bucket = batch.column("bucket")[0].as_py() if batch.num_rows else None
        if not bodies:
            return
        found = np.concatenate(bodies)
        h, place = np.unique(found["h"], return_inverse=True)
        total = np.bincount(place, weights=found["n"], minlength=len(h)).astype(np.int64)
        yield _packed([(-1, bucket, _totals(h, total, np.zeros((2, BINS), dtype=np.int64)))])
        low = 0
        for chunk, body in zip(whose, bodies, strict=True):
            own = place[low : low + len(body)]
            low += len(body)
            yield _packed([(chunk, bucket, _pairs(h[own], total[own]).tobytes())])

    return checkpointed(chunks.where("bucket >= 0").repartitionById(buckets, F.col("bucket")).mapInArrow(tell, _PACKED))


def _totals(h: np.ndarray, n: np.ndarray, bins: np.ndarray, most: int = CLASSES) -> bytes:
    """The most frequent words that training texts have, and added to bins (tokens, words) all the others."""
    h, n = h[n > 0], n[n > 0]
    order = np.lexsort((h, -n))
    best, rest = order[:most], order[most:]
    at = bins_of(n[rest])
    bins = bins + np.array([np.bincount(at, weights=n[rest], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(np.int64)
    return bins.astype("<i8").tobytes() + _pairs(h[best], n[best]).tobytes()


def _split(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(body, "<i8", count=2 * BINS).reshape(2, BINS), np.frombuffer(body, _PAIR, offset=16 * BINS)


def _merged_totals(bodies: list[bytes]) -> bytes:
    each = [_split(x) for x in bodies]
    bins = sum((x for x, _ in each), np.zeros((2, BINS), dtype=np.int64))
    best = np.concatenate([np.empty(0, _PAIR), *(x for _, x in each)])
    return _totals(best["h"], best["n"], bins)


def vocabulary_of(counted: DataFrame) -> Vocabulary:
    """The classes, from the buckets' totals, which are merged in groups before the last meet on the driver."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [-1], "bucket": rows["bucket"][:1].to_numpy(), "body": [_merged_totals(rows["body"].tolist())]})

    group = F.pmod(F.col("bucket"), F.lit(_GROUPS))
    rows = counted.where("chunk = -1").withColumn("bucket", group).groupBy("bucket").applyInPandas(merge, _PACKED).collect()  # _GROUPS rows at most
    bins, best = _split(_merged_totals([r.body for r in rows]))
    tokens = int(bins[0].sum() + best["n"].sum())
    bins, best = _split(_totals(best["h"], best["n"], bins, min(CLASSES, int(tokens**CLASSES_POWER))))
    best = best[np.argsort(best["h"])]
    return Vocabulary(best["h"].copy(), best["n"].copy(), bins[0].copy(), bins[1].copy())


class LogBilinear:
    """The model: context vectors (one more for the start), two matrices, output vectors, biases."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        rng, n = np.random.default_rng(seed), vocabulary.size
        shapes = [(n + 1, SIZE), (SIZE, SIZE), (SIZE, SIZE), (n, SIZE), (n,)]
        self.noise = (vocabulary.class_counts + 0.5) / (vocabulary.class_counts + 0.5).sum()
        scale = [0.1, 0.3, 0.3, 0.1, 0.0]
        self.weights = [(s * rng.normal(size=x)).astype(np.float32) for s, x in zip(scale, shapes, strict=True)]
        self.weights[4] = np.log(self.noise).astype(np.float32)

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        vectors, far, near, _, _ = self.weights
        return vectors[first] @ far + vectors[second] @ near

    def log_probabilities(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Normalised natural logs over all classes, a row for each context."""
        scores = self.predicted(first, second) @ self.weights[3].T + self.weights[4]
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True, dtype=np.float64))

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> int:
        """Noise-contrastive steps over batches of (two before, one before, target); returns the number of tokens."""
        rng, seen = np.random.default_rng(seed), 0
        squares = [np.full(x.shape, 1e-3, dtype=np.float32) for x in self.weights]
        log_noise = np.log(NOISE_RATIO * self.noise).astype(np.float32)
        upto = np.cumsum(self.noise)
        for first, second, target in batches:
            vectors, far, near, outputs, bias = self.weights
            guess = (vectors @ far)[first] + (vectors @ near)[second]
            own = outputs[target]
            sampled = np.minimum(np.searchsorted(upto, rng.random(NOISE), side="right"), len(upto) - 1)
            others, share = outputs[sampled], np.float32(-0.5 * NOISE_RATIO / NOISE)
            # Derivatives of the log-likelihood that data and noise are told apart; the noise's is share * (1 + false).
            true = 1 - _sigmoid(np.einsum("ij,ij->i", guess, own) + bias[target] - log_noise[target])
            false = np.float32(0.5) * guess @ others.T
            false += np.float32(0.5) * (bias[sampled] - log_noise[sampled])
            np.tanh(false, out=false)
            back = true[:, None] * own + false @ (share * others) + share * others.sum(0)
            n = np.float32(len(target))
            grads = [np.zeros_like(x) for x in self.weights]
            # Summed by class first: what follows is a product over classes, not tokens.
            by_first, by_second = np.zeros_like(vectors), np.zeros_like(vectors)
            _scatter(by_first, first, back)
            _scatter(by_second, second, back)
            grads[0] = by_first @ far.T + by_second @ near.T
            grads[1], grads[2] = vectors.T @ by_first, vectors.T @ by_second
            _scatter(grads[3], target, true[:, None] * guess)
            np.add.at(grads[3], sampled, share * (false.T @ guess + guess.sum(0)))
            grads[4] += np.bincount(target, weights=true, minlength=len(bias)).astype(np.float32)
            np.add.at(grads[4], sampled, share * (false.sum(0) + n))
            for w, g, s in zip(self.weights, grads, squares, strict=True):
                g /= n
                s += g * g
                w += np.float32(RATE) * g / np.sqrt(s)
            seen += len(target)
        return seen


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to the rows that they belong to, column by column: no sort is needed."""
    for k in range(values.shape[1]):
        into[:, k] += np.bincount(rows, weights=values[:, k], minlength=len(into))


def contexts(start: int, c: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two before, one before, target) of the tokens of texts of those sizes, as classes; start stands before a text."""
    first, second = np.empty_like(c), np.empty_like(c)
    first[2:], second[1:] = c[:-2], c[:-1]
    at = np.cumsum(sizes) - sizes
    first[at] = second[at] = start
    at = at[sizes > 1] + 1
    first[at] = start
    return first, second, c


def _classed(chunks: DataFrame, counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each chunk with what is known of its documents and their tokens' classes: (chunk, about, classes), written once."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by CLASSES and BINS
    columns = ["chunk", "about", "classes"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = shared.value
        own = rows["bucket"].to_numpy() < 0
        docs, place = _documents(rows["body"][own].iloc[0])
        told = np.concatenate([np.frombuffer(x, _PAIR) for x in rows["body"][~own]])
        told = told[np.argsort(told["h"])]
        count = told["n"]
        classes = vocabulary.classes(told["h"], count)
        starts = np.cumsum(docs["n"]) - docs["n"]
        total = lambda x: np.add.reduceat(x[place], starts)
        about = np.empty(len(docs), dtype=_ABOUT)
        for name in ("id", "has_id", "held_out", "n"):
            about[name] = docs[name]
        about["n_known"] = total((count > 0).astype(np.int64))
        about["base"], about["share"] = total(vocabulary.base_log10(count)), total(vocabulary.share_log10(classes, count))
        return pd.DataFrame([(key[0], about.tobytes(), classes[place].astype("<u2").tobytes())], columns=columns)

    rows = chunks.where("bucket < 0").union(counted.where("chunk >= 0"))
    return checkpointed(rows.groupBy("chunk").applyInPandas(run, "chunk long, about binary, classes binary"))


#: What is known of a document before the model: share sums the logs of its words' shares in their classes.
_ABOUT = np.dtype([*_DOCS.descr, ("n_known", "<i8"), ("base", "<f8"), ("share", "<f8")])


def fit(classed: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """Trains on the documents of classed that are not held out."""
    model = LogBilinear(vocabulary)
    spark = classed.sparkSession
    sizes = [x.size for x in model.weights]
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, vocabulary))  # bounded by CLASSES, BINS and SIZE

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            model, vocabulary = shared.value
            own = LogBilinear(vocabulary)
            own.weights = [x.copy() for x in model.weights]

            def batched() -> Iterator[tuple[np.ndarray, ...]]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        about = np.frombuffer(batch.column("about")[k].as_py(), _ABOUT)
                        classes = np.frombuffer(batch.column("classes")[k].as_py(), "<u2")
                        use = ~about["held_out"]
                        classes = classes[np.repeat(use, about["n"])].astype(np.int64)
                        joined = contexts(vocabulary.size, classes, about["n"][use])
                        for low in range(0, len(classes), BATCH):
                            yield tuple(x[low : low + BATCH] for x in joined)

            task = TaskContext.get().partitionId()
            seen = own.train(batched(), seed=1000 * turn + task)
            if seen:
                flat = np.concatenate([x.ravel() for x in own.weights]).astype("<f8") * seen
                parts = np.array_split(flat, _PARTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(_PARTS), pa.int32()), pa.array([task % _GROUPS] * _PARTS, pa.int32()),
                     pa.array([float(seen)] * _PARTS), pa.array([x.tobytes() for x in parts], pa.binary())],
                    names=["part", "many", "tokens", "body"],
                )

        def added(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, "<f8") for x in rows["body"]], axis=0)
            return pd.DataFrame({"part": rows["part"][:1], "many": 0, "tokens": rows["tokens"].sum(), "body": [total.tobytes()]})

        schema = "part int, many int, tokens double, body binary"
        trained = classed.select("about", "classes").mapInArrow(run, schema)
        summed = trained.groupBy("part", "many").applyInPandas(added, schema).groupBy("part").applyInPandas(added, schema).collect()
        if summed:
            flat = np.concatenate([np.frombuffer(r.body, "<f8") / r.tokens for r in sorted(summed)]).astype(np.float32)
            cuts = np.cumsum(sizes)[:-1]
            model.weights = [x.reshape(w.shape) for x, w in zip(np.split(flat, cuts), model.weights, strict=True)]
    return model


def class_scores(model: LogBilinear, contexts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of each token's class given its context, each distinct context being computed once."""
    first, second, target = contexts
    base = len(model.weights[4]) + 1
    unique, place = np.unique(first * base + second, return_inverse=True)
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(0, len(unique) + 2048, 2048))
    out = np.empty(len(target))
    for k, low in enumerate(range(0, len(unique), 2048)):
        part, rows = unique[low : low + 2048], order[ends[k] : ends[k + 1]]
        logs = model.log_probabilities(part // base, part % base)
        out[rows] = logs[place[rows] - low, target[rows]]
    return out / np.log(10)


def score_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A token is a lower-cased (A-Z) word or the text's end; a null text counts as
    empty and so has one token.  The model learns from the rows that held_out()
    does not mark.  base_score is the add-one unigram score, score the model's,
    both sums of log10 over the tokens.  Repeated rows are learned from and
    scored as often as they occur.  An empty table gives no rows.  A very long
    text is scored whole, in a chunk of its own or with what came before it.
    Other columns play no part, whatever their names.

    Chunks follow the input's partitions, and each task's model is averaged with
    the others': score, and nothing else, depends on how the input is split.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    chunks = _chunks(docs, text_col, id_col, n)
    counted = _counted(chunks, n)
    vocabulary = vocabulary_of(counted)
    classed = _classed(chunks, counted, vocabulary)
    model = fit(classed, vocabulary)
    shared = spark.sparkContext.broadcast((model, vocabulary))  # bounded by CLASSES, BINS and SIZE

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                about = np.frombuffer(batch.column("about")[k].as_py(), _ABOUT)
                classes = np.frombuffer(batch.column("classes")[k].as_py(), "<u2").astype(np.int64)
                own = class_scores(model, contexts(vocabulary.size, classes, about["n"]))
                total = np.add.reduceat(own, np.cumsum(about["n"]) - about["n"]) + about["share"]
                out = [pa.array(about["id"], mask=~about["has_id"]), pa.array(about["held_out"]), *(pa.array(about[c]) for c in ("n", "n_known")),
                       pa.array(np.full(len(about), vocabulary.tokens)), pa.array(about["base"]), pa.array(total)]
                yield pa.RecordBatch.from_arrays(out, names=_COLUMNS)

    kinds = ["long", "boolean", "long", "long", "long", "double", "double"]
    return classed.select("about", "classes").mapInArrow(score, ", ".join(f"{c} {k}" for c, k in zip(_COLUMNS, kinds, strict=True)))


_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

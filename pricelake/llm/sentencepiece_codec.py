"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new words are written one after the other as one text, whose suffixes
are sorted by their first characters.  Every piece of the model then finds its
occurrences as a range of that order by binary search, all pieces at once.  An
occurrence is an edge from its first character to the one after its last; the
edges, sorted by position, are relaxed: an edge is taken where the text before
it is already spelt and its piece may stand beside the piece that ends there.

Two pieces of a pair model may stand side by side if merging, best score first,
makes just these two of their joint text; a spelling is the model's own if that
holds for all its neighbours, and there is one such spelling.  The answers of
that question are remembered.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm import memory
from pricelake.llm.common import text_of

SPACE = "▁"
#: Words (as many again from before) and pairs of pieces that a worker remembers.
WORDS_MOST, PAIRS_MOST = 150_000, 1_000_000
#: Characters matched at a time, and the longest word that is remembered.
BATCH_CHARACTERS, LONGEST = 1 << 17, 200


class PieceModel:
    """A pair model with byte fallback, read from a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        of, n = self.processor, self.processor.get_piece_size()
        special = lambda i: of.is_unknown(i) or of.is_control(i) or of.is_byte(i) or of.is_unused(i)
        self.text = [of.id_to_piece(i) for i in range(n)]
        self.score = [of.get_score(i) for i in range(n)]
        self.byte_ids = [of.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.control = {i for i in range(n) if of.is_control(i)}
        self.pieces = {self.text[i]: i for i in range(n) if not special(i) and self.text[i]}
        self.longest = max(map(len, self.pieces))
        # Pieces sorted as text, and for each the last text that begins with it.
        ordered = sorted(self.pieces)
        self.rows = np.array(ordered, dtype=f"<U{self.longest}")
        self.lengths = np.array([len(x) for x in ordered])
        self.ids = np.array([self.pieces[x] for x in ordered])
        self.characters = np.array(sorted(ord(x) for x in ordered if len(x) == 1), dtype=np.uint32)
        ends = self.rows.view(np.uint32).reshape(-1, self.longest).copy()
        ends[np.arange(self.longest)[None, :] >= self.lengths[:, None]] = 0x10FFFF
        self.ends = np.ascontiguousarray(ends).view(f"<U{self.longest}").reshape(-1)
        #: Pairs of pieces asked about, ascending, and whether they may stand side by side.
        self.pairs = np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known, self.before = {}, {}

    def merged(self, text: str) -> list[str]:
        """Merging as the model has it: the best scored pair of neighbours first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                got = self.pieces.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or self.score[got] > best[0]):
                    best = (self.score[got], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_stand(self, keys: np.ndarray) -> np.ndarray:
        """For pairs of pieces (first * size + second): whether merging their joint text makes just the two."""
        asked, place = np.unique(keys, return_inverse=True)
        pairs, answers = self.pairs
        at = np.minimum(np.searchsorted(pairs, asked), max(0, len(pairs) - 1))
        new = asked[pairs[at] != asked] if len(pairs) else asked
        if len(new):
            if len(pairs) + len(new) > PAIRS_MOST:
                pairs, answers, new = np.empty(0, np.int64), np.empty(0, bool), asked
            size, text = len(self.text), self.text
            got = [self.merged(text[k // size] + text[k % size]) == [text[k // size], text[k % size]] for k in new.tolist()]
            pairs, answers = np.concatenate([pairs, new]), np.concatenate([answers, np.array(got, dtype=bool)])
            order = np.argsort(pairs, kind="stable")
            self.pairs = pairs, answers = pairs[order], answers[order]
            at = np.searchsorted(pairs, asked)
        return answers[at][place]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, length, piece) of every occurrence of a piece in a text of character codes."""
        width = self.longest
        padded = np.concatenate([codes, np.zeros(width, dtype=np.uint32)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)]
        suffixes = np.ascontiguousarray(windows).view(f"<U{width}").reshape(-1)
        order = np.argsort(suffixes, kind="stable")
        low = np.searchsorted(suffixes, self.rows, side="left", sorter=order)
        high = np.searchsorted(suffixes, self.ends, side="right", sorter=order)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        return at, self.lengths[which], self.ids[which]

    def _learn(self, words: list[str]) -> None:
        """Spells words, matched together as one text; a NUL stands between them."""
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(x) for x in words])
        starts = np.cumsum(sizes + 1) - sizes - 1
        # At each place: the piece that ends there (-1: none yet, -2: a spelling begins) and where it begins.
        last, back = np.full(len(codes) + 1, -1), np.full(len(codes) + 1, -1)
        unknown = np.flatnonzero(~np.isin(codes, self.characters))  # spelt as bytes; and the NULs
        last[unknown + 1], back[unknown + 1] = -2, unknown
        last[starts] = -2
        at, length, piece = self.edges(codes)
        # Words are relaxed side by side: first the edges from their first characters, then from the second ones.
        depth = at - starts[np.searchsorted(starts, at, side="right") - 1]
        order = np.argsort(depth, kind="stable")
        at, to, piece = at[order], at[order] + length[order], piece[order]
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            p, t, own = at[low:high], to[low:high], piece[low:high]
            use = (last[t] == -1) & (last[p] != -1)
            p, t, own = p[use], t[use], own[use]
            before = last[p]
            good = before == -2
            if not good.all():
                good[~good] = self.may_stand(before[~good] * len(self.text) + own[~good])
            last[t[good]], back[t[good]] = own[good], p[good]
        spelt, whose, place, live = [], [], starts + sizes, np.flatnonzero(sizes)
        while len(live):
            now = place[live]
            spelt.append(np.where(last[now] >= 0, last[now], -1 - back[now]))
            whose.append(live)
            place[live] = back[now]
            live = live[place[live] > starts[live]]
        ids, whose = np.concatenate([np.empty(0, np.int64), *spelt[::-1]]), np.concatenate([np.empty(0, np.int64), *whose[::-1]])
        ids = ids[np.argsort(whose, kind="stable")]
        ends = np.cumsum(np.bincount(whose, minlength=len(words))).tolist()
        odd = set(np.unique(whose[np.argsort(whose, kind="stable")][ids < 0]).tolist())
        body, begin = ids.astype("<u4").tobytes(), 0
        for i, (word, end) in enumerate(zip(words, ends, strict=True)):
            if i in odd:
                own = [[x] if x >= 0 else [self.byte_ids[b] for b in text[-1 - x].encode("utf-8", "surrogatepass")] for x in ids[begin:end].tolist()]
                self.known[word] = array("I", [y for x in own for y in x]).tobytes()
            else:
                self.known[word] = body[4 * begin : 4 * end]
            begin = end

    def spell_long(self, word: str) -> bytes:
        """One very long word: its edges are matched a stretch at a time and relaxed in order of position."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
        unknown = ~np.isin(codes, self.characters)
        # At each place the piece that ends there (-1: none yet, -2: a spelling begins) and its length.
        last, size = array("i", [-1]) * (len(codes) + 1), array("i", [0]) * (len(codes) + 1)
        last[0] = -2
        answers: dict[int, bool] = {}
        pieces = len(self.text)
        for low in range(0, len(codes), BATCH_CHARACTERS):
            part = codes[low : low + BATCH_CHARACTERS + self.longest]
            at, length, piece = self.edges(part)
            own = at < BATCH_CHARACTERS
            order = np.argsort(at[own], kind="stable")
            edges = zip((at[own][order] + low).tolist(), length[own][order].tolist(), piece[own][order].tolist(), strict=True)
            odd = iter([*(np.flatnonzero(unknown[low : low + BATCH_CHARACTERS]) + low).tolist(), len(codes)])
            byte = next(odd)
            for p, n, i in edges:
                while byte < p:
                    last[byte + 1], size[byte + 1] = -2, 1
                    byte = next(odd)
                before = last[p]
                if before == -1 or last[p + n] != -1:
                    continue
                if before >= 0:
                    key = before * pieces + i
                    good = answers.get(key)
                    if good is None:
                        if len(answers) >= PAIRS_MOST:
                            answers.clear()
                        a, b = self.text[before], self.text[i]
                        answers[key] = good = self.merged(a + b) == [a, b]
                    if not good:
                        continue
                last[p + n], size[p + n] = i, n
            while byte < min(len(codes), low + BATCH_CHARACTERS):
                last[byte + 1], size[byte + 1] = -2, 1
                byte = next(odd)
        out, p = array("I"), len(codes)
        while p:
            if last[p] >= 0:
                out.append(last[p])
                p -= size[p]
            else:
                p -= 1
                out.extend(self.byte_ids[b] for b in reversed(word[p].encode("utf-8", "surrogatepass")))
        out.reverse()
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's identifiers, little-endian unsigned 32-bit, as the processor itself has them."""
        memory.use(self)
        split = [_words(x) for x in texts]
        if len(self.known) > WORDS_MOST:
            self.known, self.before = {}, self.known
        known, before, new = self.known, self.before, []
        for x in set().union(*split).difference(known):
            if (got := before.get(x)) is None:
                new.append(x)
            else:
                known[x] = got
        new.sort()
        long = [x for x in new if len(x) > LONGEST]
        for x in long:
            if len(x) > BATCH_CHARACTERS:
                known[x] = self.spell_long(x)
        new = [x for x in new if len(x) <= BATCH_CHARACTERS]
        held, size = [], 0
        for x in [*new, None]:
            if x is None or size + len(x) > BATCH_CHARACTERS and held:
                if held:
                    self._learn(held)
                held, size = [], 0
            if x is not None:
                held.append(x)
                size += len(x) + 1
        out = [b"".join(map(self.known.__getitem__, x)) for x in split]
        for x in long:
            del self.known[x]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of identifiers; byte pieces join to UTF-8, the space put before the text goes."""
        parts, held = [], b""
        for i in array("I", ids):
            if i in self.byte_of:
                held += self.byte_of[i]
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = b""
            if i not in self.control:
                parts.append(self.text[i].replace(SPACE, " "))
        if held:
            parts.append(held.decode("utf-8", "replace"))
        out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


def _words(text: str) -> list[str]:
    """A text with a space put before it, cut before each run of spaces that follows another character."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " " != text[-1] and "\0" not in text:
        return [SPACE + x for x in text.split(" ")]
    marked = SPACE + text.replace(" ", SPACE)
    out, low = [], 0
    for i in range(1, len(marked)):
        if marked[i] == SPACE != marked[i - 1]:
            out.append(marked[low:i])
            low = i
    return [*out, marked[low:]]


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    """The worker's own model; it lives as long as the worker."""
    return PieceModel(path)


def encode(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: doc_id, ids (little-endian unsigned 32-bit).

    A null text counts as empty and has none.  Rows stay as they are, repeated
    ones too; an empty table gives none.  Texts are encoded whole; a word of more
    than BATCH_CHARACTERS characters takes some 20 bytes a character.  Other
    columns play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = piece_model(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = pa.array(of.encode(part.column("text").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encode()'s rows with the text that the identifiers spell: doc_id, ids, text.

    Null ids count as none and spell the empty text; a null doc_id stays.  Rows
    stay as they are, repeated ones too; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = piece_model(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = pa.array([of.decode(x) for x in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_sha256 (of the decoded text)."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def crc32(ids: list[int]) -> int:
    """What ids_crc32 holds for identifiers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())

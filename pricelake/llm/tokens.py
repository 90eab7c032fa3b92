"""Token identifiers of whole texts, a distinct word being encoded once.

Both vocabularies cut a text before they merge, and never merge across a cut.
A single space between two other characters is such a cut (byte-level: the
space leads the next piece; word-level: spaces vanish), so a text's identifiers
are those of its words in a row, and a worker encodes each word once.  Words of
letters go straight to the tokenizer's model, since they are one piece; all
others take the whole way.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pricelake.llm import memory

#: Words that a worker remembers (as many again from before), and the longest that it does.
REMEMBERED, LONGEST = 400_000, 200
_DOUBLE = re.compile(r"\s\s").search
_CUT = re.compile(r"(?<=\S) (?=\S)").split
#: Marks at a word's end that neither vocabulary merges with a letter before them.
_MARKS = frozenset(".,;:!?")
#: Letters below this are their own NFC form, and (but for one) lower-case the same everywhere.
_PLAIN, _NOT_PLAIN = "\u0250", "\u0130"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a character: printable ones as themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit identifiers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        self.model = self.of.model
        #: Whether a space leads the piece after it, or vanishes where words end by a mark.
        self.spaced = not self.model.end_of_word_suffix
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.marks = {x: self._whole([x])[0] for x in [*_MARKS, "\n"]}

    def forget(self) -> None:
        self.known, self.before = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's own way from text to identifiers."""
        return [array("I", x.ids).tobytes() for x in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str, lead: str) -> bytes:
        """A word of letters, by the model."""
        if not self.spaced:
            word = word.lower()
        piece = lead + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def _quick(self, word: str, lead: str) -> bytes | None:
        """Letters, perhaps with a mark at the end, or such words with a line end between; None: anything else."""
        body, mark = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
        if body.isalpha() and (self.spaced or body.isascii() or (max(body) < _PLAIN and _NOT_PLAIN not in body)):
            out = self._letters(body, lead)
            return out + self.marks[mark] if mark else out
        if "\n" not in word:
            return None
        lines = [self._quick(x, lead if i == 0 else "") for i, x in enumerate(word.split("\n"))]
        return None if None in lines else (self.marks["\n"] if self.spaced else b"").join(lines)

    def _codes(self, words: list[str]) -> list[bytes]:
        """The identifiers of distinct words, each encoded once as long as it is remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        lead, space = (_LETTERS[32], " ") if self.spaced else ("", "")
        rest, long, marks, tokenize = [], [], self.marks, self.model.tokenize
        for x in [x for x in words if x not in known]:
            if len(x) > LONGEST:
                long += [x, x[:-1]]
            if (got := before.get(x)) is None:
                body, mark = (x[:-1], marks[x[-1]]) if x[-1:] in _MARKS else (x, b"")
                if mark and (got := known.get(body)) is not None:
                    got += mark
                elif body.isascii() and body.isalpha():
                    got = array("I", [t.id for t in tokenize(lead + (body if space else body.lower()))]).tobytes()
                    if mark:
                        known[body], got = got, got + mark
                elif x[:1] == "\n" and self.spaced:
                    after = self._quick(x[1:], "")
                    got = marks["\n"] + (self._whole([x[1:]])[0] if after is None else after)
                elif (got := self._quick(x, lead)) is None:
                    rest.append(x)
                    continue
            known[x] = got
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            known.update(zip(part, self._whole([space + x for x in part]), strict=True))
        out = list(map(known.__getitem__, words))
        for x in long:
            known.pop(x, None)
        return out

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """Each text's words; where spaces lead, all but the first stand for a space and themselves.

        A line end between two words is a blank like others where blanks vanish.
        Where they lead it is a piece of its own, and the word after it has no
        space: that word is led by the line end instead.
        """
        line = " \n" if self.spaced else " "
        if self.spaced:
            strings = texts.to_pylist()
            if any(map(_DOUBLE, strings)):
                return pa.array([_CUT(x) if _DOUBLE(x) else x.replace("\n", line).split(" ") for x in strings], pa.list_(pa.string()))
        return pc.split_pattern(pc.replace_substring(texts, "\n", line), " ")

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers of the texts in a row (with end_id after each, if given), and where each text's begin; last, where they end.

        Words are told apart and put in place as numbers of a dictionary; only a
        batch's distinct words are looked up one by one.
        """
        memory.use(self)
        n = len(texts)
        cut = self._split(texts)
        bounds, found = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        places, words = found.indices.to_numpy(), found.dictionary.to_pylist()
        if self.spaced and n:
            firsts, used = bounds[:-1], np.zeros(len(words), dtype=bool)
            inner = np.ones(len(places), dtype=bool)
            inner[firsts] = False
            used[places[inner]] = True
            leading = self._whole([words[i] for i in places[firsts].tolist()])
            codes = [b""] * len(words)
            asked = np.flatnonzero(used).tolist()
            for i, code in zip(asked, self._codes([words[i] for i in asked]), strict=True):
                codes[i] = code
            places = places.copy()
            places[firsts] = len(words) + np.arange(n)
            codes += leading
        else:
            codes = self._codes(words)
        flat = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) >> 2
        begins = np.cumsum(sizes) - sizes
        each = sizes[places]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begins[places] - (ends - each), each) + np.arange(ends[-1] if n else 0)]
        starts = np.concatenate([[0], ends[bounds[1:] - 1]]).astype(np.int64)
        if end_id is not None:
            ids, starts = np.insert(ids, starts[1:], np.uint32(end_id)), starts + np.arange(n + 1)
        return ids, starts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's identifiers, as bytes."""
        ids, starts = self.encode_all(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder; it lives as long as the worker."""
    return Encoder(path)

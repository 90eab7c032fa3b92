import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_exact_packing_tokens import TEXTS, WORD, ids

from pricelake.llm import flat_tokens
from pricelake.llm.flat_tokens import count_flat, counts_by_document, write_flat
from pricelake.llm.sentencepiece_codec import PieceModel, crc32, decode, digests, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  ", " a", "a ", "a  b\n\n c \t d", "é́ é ΣΑΣ \x1c x", "　 a  b", "x" * 3000, "中文字符 日本語", "\0 a\0b", "<0x41> <unk> <s>", "🎉🎉 ok", "    def f(x):\n        return 1", "hello" * 90]


def test_encoding_is_the_processors_own(monkeypatch):
    from pricelake.llm import sentencepiece_codec

    monkeypatch.setattr(sentencepiece_codec, "PAIRS_MOST", 60)
    monkeypatch.setattr(sentencepiece_codec, "BATCH_CHARACTERS", 400)
    m, p = PieceModel(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, "a▁b ▁▁ c", "The quick brown fox's jumping over 12,345 lazy dogs; don't!", "Élève für größer niño"]
    got = [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)]
    assert got == p.encode(texts)
    assert [m.decode(np.array(x, "<u4").tobytes()) for x in got] == p.decode(got)
    assert [m.decode(np.array(x, "<u4").tobytes()) for x in got[: len(ODD)]] == ODD


def test_very_long_words_are_spelt_in_stretches(monkeypatch):
    import random

    from pricelake.llm import sentencepiece_codec

    monkeypatch.setattr(sentencepiece_codec, "BATCH_CHARACTERS", 5000)
    m, p = PieceModel(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(40_000)), "中🎉a" * 9000, "lorem" * 6000 + " end", "ab" * 2500]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == p.encode(texts)
    assert not any(len(x) > 200 for x in m.known)


def test_edges_are_all_occurrences():
    m = PieceModel(MODEL)
    text = "▁the▁theatre\0▁a"
    at, length, piece = m.edges(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    got = sorted(zip(at.tolist(), length.tolist(), piece.tolist(), strict=True))
    want = sorted((i, n, m.pieces[text[i : i + n]]) for i in range(len(text)) for n in range(1, m.longest + 1) if i + n <= len(text) and text[i : i + n] in m.pieces)
    assert got == want


def test_round_trip_as_queries(docs):
    rows = [*TEXTS, *enumerate(ODD, 100)]
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = digests(decode(encode(docs(rows, extra=["ids"]), MODEL), MODEL)).collect()
    want = [(i, len(own := p.encode(t or "")), crc32(own), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert encode(docs([]), MODEL).count() == 0


@pytest.mark.parametrize("block", [3, 64, flat_tokens.BLOCK])
def test_counts_of_flat_files(spark, docs, tmp_path, block):
    rows = TEXTS
    folder = str(tmp_path / "flat")
    manifest = write_flat(docs(rows, extra=["file", "ordinal"]).repartition(3), folder, WORD, 49407).cache()
    assert manifest.count() == len(rows)
    got = counts_by_document(count_flat(spark, folder, 49407, block), manifest).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(ids(WORD, t, 49407))) for i, t in rows)
    by_file = {}
    for r in sorted(got, key=lambda r: (r.file, r.start)):
        assert r.start == by_file.get(r.file, 0)
        by_file[r.file] = r.start + r.n_tokens


def test_unfinished_and_empty_files(spark, docs, tmp_path):
    for name, tokens in (("a", [5, 9, 7, 7]), ("b", [9, 9]), ("c", []), ("d", [1, 2, 3])):
        (tmp_path / f"{name}.tokens").write_bytes(np.array(tokens, "<u2").tobytes())
    got = sorted(map(tuple, count_flat(spark, str(tmp_path), 9, 2).collect()))
    assert got == [("a.tokens", 0, 0, 2, True), ("a.tokens", 1, 2, 2, False), ("b.tokens", 0, 0, 1, True), ("b.tokens", 1, 1, 1, True), ("d.tokens", 0, 0, 3, False)]
    assert write_flat(docs([]), str(tmp_path / "none"), WORD, 9).select(F.count("*")).first()[0] == 0

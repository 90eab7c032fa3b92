import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pricelake.llm.exact_dedup import duplicate_groups, exact_dedup
from pricelake.llm.packing import SumOfSquares, pack, piece_digests
from pricelake.llm.token_files import read_orc, with_crc32, write_orc
from pricelake.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
TEXTS = [
    (1, "a b c"), (2, "a b c"), (3, ""), (4, None), (5, "A b c"), (9, "x" * 5000), (7, "x" * 5000), (None, "a b c"),
    (8, "long text here, " * 700), (8, "long text here, " * 700), (12, "a  b\n\nc \t <|endoftext|> é's ΣΑΣ　y "), (13, " lead"),
]


def ids(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_against_groups(docs, keep):
    df = docs(TEXTS, extra=["key", "kept", "row"])
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    best = {}
    for t, own in groups.items():
        known = [i for i in own if i is not None]
        best[t] = (max if keep == "max" else min)(known) if known else None
    got = duplicate_groups(df, keep=keep).collect()
    assert len(got) == len(TEXTS)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        assert r.keep_id == best[sha[r.text_sha256]] and r.group_size == len(groups[sha[r.text_sha256]])
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)
    rows = exact_dedup(df, keep=keep).collect()
    assert sorted((r.text or "", r.doc_id) for r in rows) == sorted(best.items())
    assert rows[0].key == rows[0].kept == rows[0].row == "mine"


def test_exact_dedup_hot_text_and_empty(docs):
    rows = [(i, "copy of a hot text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(100)]
    df = docs(rows).repartition(5)
    got = {r.id: r for r in duplicate_groups(df).collect()}
    assert len(got) == 400 and all(got[i].group_size == 300 and got[i].keep_id == 299 for i in range(300))
    assert [i for i in range(300) if got[i].kept] == [299]
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == [299, *range(1000, 1100)]
    assert duplicate_groups(docs([])).count() == 0 and exact_dedup(docs([])).count() == 0


def test_encoder_equals_whole_text_encoding(monkeypatch):
    from pricelake.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    texts = [t or "" for _, t in TEXTS] + [" ", "a ", " a", "don't  we'll 12.50, ", "\n\nx\n y", "Iİı ñ\x1cz"]
    for path in (BYTE, WORD):
        e = Encoder(path)
        for _ in range(2):
            got = e.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids(path, t, 0)[:-1] for t in texts]


def test_encoder_where_no_blanks_meet():
    texts = ["a\nb c.\nD e,f", "\nx y", "x\n", "\n", "", "é.\nÈ 1\n2 it's\n'tis", "a b\nİx ñ\t1", "don't\n12.5 wé.\n?!", "word " * 50 + "end.\nNext"]
    for path in (BYTE, WORD):
        flat, starts = Encoder(path).encode_all(pa.array(texts), 7)
        got = [flat[a:b].tolist() for a, b in zip(starts, starts[1:])]
        assert got == [[*ids(path, t, 0)[:-1], 7] for t in texts]
        assert [len(x) for x in Encoder(path).encode_all(pa.array([], pa.string()))] == [0, 1]


def check_pieces(rows, want, capacity):
    """rows: (doc, start, length, ids, n, sequence, offset); want: identifiers of the documents, in any order."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r[5]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at and r[2] > 0
            at += r[2]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
    for doc, whole in want.items():
        whole = [tuple(x) for x in whole]
        pieces = sorted(by_doc[doc], key=lambda r: r[1])
        assert sum(r[2] for r in pieces) == sum(map(len, whole))
        for r in pieces:
            assert any(tuple(r[3]) == x[r[1] : r[1] + r[2]] and len(x) == r[4] for x in whole)
    return padding


def test_sum_of_squares_places_every_identifier_once():
    rng = np.random.default_rng(3)
    rows = []

    def emit(window, pieces, poured):
        at = 0
        for doc, start, raw, n in pieces:
            rows.append((doc, start, len(raw) // 4, np.frombuffer(raw, "<u4").tolist(), n, window, at))
            at += len(raw) // 4

    packer, want = SumOfSquares(64, emit), {}
    for doc in range(700):
        own = rng.integers(0, 2**32, int(rng.integers(1, 200)), dtype=np.uint32)
        want[doc] = [own.tolist()]
        packer.add(doc, own.astype("<u4").tobytes())
    packer.finish()
    assert check_pieces(rows, want, 64) == 0


def test_sum_of_squares_rule():
    packer = SumOfSquares(10, lambda *_: None)
    packer.level[[4, 6]] = [5, 1]
    assert packer._fill_for(4) == 4  # one of five windows of fill 4 leaves: 25 -> 16, and 0 -> 1
    packer.level[:] = 0
    packer.level[3] = 1
    assert packer._fill_for(3) == 3  # 1 -> 0 and 0 -> 1 beats two windows of fill 3
    assert packer._fill_for(8) == 0


def test_pack_rows(docs):
    df = docs(TEXTS, extra=["ids", "id"])
    rows = [(r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in pack(df, BYTE, 128).collect()]
    want = defaultdict(list)
    for i, t in TEXTS:
        want[i].append(ids(BYTE, t, 0))
    assert check_pieces(rows, want, 128) == 0
    one = piece_digests(pack(docs([(4, None)]), BYTE)).collect()
    assert [tuple(r) for r in one] == [(4, 0, 1, crc([0]), 1, one[0].sequence_id, 0, True)]
    assert pack(docs([]), BYTE).count() == 0


def test_token_orc_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "orc")
    write_orc(docs(TEXTS, extra=["ids", "part"]), path, WORD)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in with_crc32(read_orc(spark, path)).collect())
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at, want = 0, []
    for i, t in order:
        own = ids(WORD, t, 1)
        want.append((at, i, len(own), crc(own)))
        at += len(own)
    assert got == want
    assert [r.ids for r in read_orc(spark, path).where("doc_id = 5").collect()] == [ids(WORD, "A b c", 1)]
    empty = str(tmp_path / "none")
    write_orc(docs([]), empty, WORD)
    assert with_crc32(read_orc(spark, empty)).count() == 0


def test_orc_metadata_spares_stripes_and_rows(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    path, none = str(tmp_path / "orc"), F.lit(None).cast("string")
    wide = spark.range(0, 12_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * k % 997).cast("string")) for k in range(1, 40)]).alias("text"), none.alias("lang"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        write_orc(wide, path, WORD)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = spark.read.orc(path)

    def read(doc: int) -> tuple[int, int]:
        """Rows found, and rows that the reader gave to the filter."""
        df = rows.where(F.col("doc_id") == doc).select("doc_id", "n_tokens")
        found = len(df.collect())
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, scan.metrics().get("numOutputRows").get().value()

    assert rows.count() == 6000
    found, seen = read(4242)
    assert found == 1 and seen <= 1000  # the row index: one entry of 1,000 rows
    assert sum(read(odd)[1] for odd in range(1001, 1201, 20)) <= 1000  # between the least and the largest, but in no Bloom filter (1 % pass one)
    assert read(50_000) == (0, 0)

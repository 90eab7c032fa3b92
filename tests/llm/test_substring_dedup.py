import hashlib
import random
import re

from pricelake.llm.common import WORD
from pricelake.llm.substring_dedup import remove_repeats, repeat_digests


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept text) of each row."""
    first = {}
    for i, t in rows:
        w = re.findall(WORD, t or "")
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        w, gone = re.findall(WORD, t or ""), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (float("inf") if i is None else i):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    text = lambda k: [word() for _ in range(k)]
    shared = [text(k) for k in (9, 10, 11, 24, 60)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += text(rng.randint(0, 30)) + (rng.choice(shared) if rng.random() < 0.6 else [])
        rows.append((i, " ".join(parts)))
    rows += [(5000 + i, rows[3][1] + " tail " + " ".join(shared[4])) for i in range(30)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (rows[7][0], rows[7][1]), (rows[8][0], rows[9][1]), (9000, None), (9001, ""), (9002, "x " * 5000), (9003, "x\t" * 5000), (-5, " ".join(shared[2]))]
    return rows


def test_against_brute_force(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        got = repeat_digests(docs(rows, extra=["id", "chunk", "row", "kept"]), window=10).collect()
        want = [(i, n, r, hashlib.sha256(t.encode()).hexdigest()) for i, n, r, t in brute(rows, 10)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert sum(r.n_removed for r in got) > 1000


def test_text_is_cut_and_rows_stay(docs):
    rows = corpus(3, 40)
    df = docs(rows, extra=["id", "chunk", "row", "kept"])
    got = remove_repeats(df, window=10)
    assert got.columns == df.columns
    want = sorted(str((i, kept if gone else t)) for (i, t), (_, _, gone, kept) in zip(rows, brute(rows, 10), strict=True))
    out = got.collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == want
    assert {r.kept for r in out} == {"mine"}


def test_empty_table(docs):
    assert repeat_digests(docs([])).count() == 0
    assert remove_repeats(docs([])).count() == 0

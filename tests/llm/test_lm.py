import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pricelake.llm import lm
from pricelake.llm.lm import BINS, LogBilinear, Vocabulary, class_scores, contexts, score_texts


def vocabulary(words, counts, bins):
    tokens, own = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for k, (n, w) in bins.items():
        tokens[k], own[k] = n, w
    return Vocabulary(np.array(words, dtype=np.uint64), np.array(counts), tokens, own)


def tokens(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def corpus(n=600):
    rng = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(rng.randint(3, 30)):
            k = min(int(rng.expovariate(0.2)), 39)
            t += ["The", nouns[k], verbs[k], rng.choice(["a", "the"]), f"rare{rng.randint(0, 4000)}"]
        rows.append((i, " ".join(t)))
    return [*rows, (5000, None), (5001, ""), (5002, "unseen words only " * 900), (None, "the n1"), rows[2]]


@pytest.mark.parametrize("chunk", [lm.CHUNK_TOKENS, 700])
def test_counts_base_and_model_scores(docs, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    rows = corpus()
    got = score_texts(docs(rows, extra=["chunk", "held_out", "score"])).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    total, v = sum(c.values()), len(c)
    by = {i: t for i, t in rows}
    for r in got:
        own = tokens(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(own), sum(w in c for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_scores_are_normalised_and_equal_one_by_one():
    v = vocabulary([11, 22, 33], [30, 20, 10], {0: (1, 1), 1: (4, 2), 2: (35, 7)})
    assert (v.bins, v.size, v.tokens, v.distinct) == (3, 6, 100, 13)
    m = LogBilinear(v)
    first, second = np.array([0, 4, 2, 0]), np.array([1, 6, 3, 1])
    assert np.exp(m.log_probabilities(first, second)).sum(1) == pytest.approx(1.0)
    target = np.array([2, 0, 1, 3])
    want = [m.log_probabilities(first[i : i + 1], second[i : i + 1])[0, target[i]] / math.log(10) for i in range(4)]
    assert class_scores(m, (first, second, target)) == pytest.approx(want)
    h, counts = np.array([5, 6, 7, 22], dtype=np.uint64), np.array([1, 3, 100, 20])
    assert v.classes(h, counts).tolist() == [0, 1, 2, 4]
    # Each class's shares sum to one, words never seen being one more word of the first.
    for k, own in ((0, [1, 0]), (1, [2, 2]), (2, [5, 5, 5, 5, 5, 5, 5])):
        assert sum(10 ** v.share_log10(np.full(len(own), k), np.array(own))) == pytest.approx(1.0)
    assert v.share_log10(np.array([4]), np.array([20]))[0] == 0


def test_contexts_stop_at_texts():
    first, second, target = contexts(9, np.array([1, 2, 3, 4, 5, 6]), np.array([3, 1, 2]))
    assert first.tolist() == [9, 9, 1, 9, 9, 9] and second.tolist() == [9, 1, 2, 9, 9, 5] and target.tolist() == [1, 2, 3, 4, 5, 6]


def test_training_learns_a_pattern():
    v = vocabulary([1, 2, 3, 4], [250] * 4, {0: (1, 1)})
    m = LogBilinear(v)
    seq = np.tile([1, 2, 3, 4], 4000)
    batches = [(seq[i : i + 512], seq[i + 1 : i + 513], seq[i + 2 : i + 514]) for i in range(0, 15000, 512)] * 3
    m.train(iter(batches), 1)
    logs = m.log_probabilities(np.array([1, 2]), np.array([2, 3]))
    assert np.exp(logs[0, 3]) > 0.8 and np.exp(logs[1, 4]) > 0.8


def test_empty_table(docs):
    assert score_texts(docs([])).count() == 0
    only_held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = score_texts(docs([(only_held_out, "a b")])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelake.llm import periodic
from pricelake.llm.common import WORD
from pricelake.llm.periodic import Catchers, planted, repeated_runs, run_digests


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                s, e = i, j + q
                if e - s >= max(least, times * q) and not any(all(w[x] == w[x + d] for x in range(s, e - d)) for d in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def caught(numbers, stretch):
    c = Catchers()
    for low in range(0, len(numbers), stretch):
        c.append(np.array(numbers[low : low + stretch], dtype=np.int64), min(low + stretch, len(numbers)))
    return [tuple(map(int, r)) for r in c.finish(len(numbers))]


def repetitive(rng, n, letters):
    out = []
    while len(out) < n:
        kind = rng.random()
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        if kind < 0.3 and out:
            k = rng.randint(1, len(out))
            part = out[-k:]
        out += part * rng.choice([1, 1, 2, 4, 5, 9])
    return out[:n]


@pytest.mark.parametrize("seed", range(12))
def test_catchers_against_brute_force(seed):
    rng = random.Random(seed)
    for n in (0, 1, 5, 6, 7, 8, 24, 60, 150, 333):
        for letters in (1, 2, 3, 50):
            w = repetitive(rng, n, letters)
            want = brute_runs(w)
            for stretch in (1, 7, 64, 1000):
                assert caught(w, stretch) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 100))
def test_catchers_on_any_words(w, stretch):
    assert caught(w, stretch) == brute_runs(w)


def test_words_whose_hashes_collide():
    # In a Thue-Morse sequence hashes of long windows are equal where the words aren't.
    w = [bin(i).count("1") & 1 for i in range(1 << 13)]
    assert caught(w, 1 << 13) == []
    assert [r for r in caught([*w[:3000], *[7, 8, 9] * 5000], 999)] == [(3000, 15000, 3)]


def brute(rows):
    out = []
    for i, t in rows:
        w = re.findall(WORD, t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else None
        gone = {x for s, k, q in runs for x in range(s + q, s + k)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(kept)))
    return sorted(map(str, out))


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10**6), 150):
        w = repetitive(rng, rng.randint(0, 200), rng.choice([1, 3, 60]))
        rows.append((i, rng.choice([" ", "\t\n", "  "]).join(f"wö{x}" for x in w)))
    return rows + [(1, None), (2, ""), (None, "a b " * 20), (3, "\r\n"), rows[0], (4, "A a A a A a A a"), (5, "long " + "z" * 50000)]


@pytest.mark.parametrize("shared", [40, 1 << 16])
def test_against_brute_force(docs, monkeypatch, shared):
    monkeypatch.setattr(periodic, "SHARED", shared)
    rows = corpus()
    got = run_digests(repeated_runs(docs(rows, extra=["runs", "start", "period", "collapsed"]), planted)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert sum(r.n_runs for r in got) > 200


def test_a_very_long_text(docs):
    text = "x y z " * 100_000 + "end"
    got = run_digests(repeated_runs(docs([(1, text)]))).first()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (1, 0, 300_000, 3, 100_000_000)
    assert got.collapsed_sha256 == hashlib.sha256(b"x y z end").hexdigest()
    plain = " ".join(f"w{i * i % 99991}" for i in range(200_000))
    assert repeated_runs(docs([(1, plain)])).first().collapsed == plain


def test_empty_table_and_refusals(docs):
    assert repeated_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        repeated_runs(docs([]), times=2)

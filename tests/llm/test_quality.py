import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm.quality import BUCKETS, ORDERS, _counts, _kth_largest, good_share, keep_quality, ngrams, quality_weights


def corpus(n=400):
    rng = random.Random(5)
    syllables = ["an", "th", "er", "on", "in", "es", "re", "ti", "st", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, bad = [], set()
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 200))]
        if i % 8 == 0:
            bad.add(i)
            words = [w.upper() + "!!" for w in words] if i % 16 else [w for w in words for _ in range(9)]
        rows.append((i, " ".join(words).capitalize() if i % 8 else " ".join(words)))
    return rows, bad


def test_held_out_accuracy(spark, docs):
    rows, bad = corpus()
    df = docs([*rows, (None, "an ther in"), (1000, None), (1001, ""), rows[1]], extra=["weight", "key", "kept"])
    labels = spark.createDataFrame([(i, int(i not in bad), None) for i, _ in rows if i % 3] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    keep = (len(rows) - len(bad) + 4) / (len(rows) + 4)  # as many as are clean; 1 is there twice
    got = {r.doc_id: r.kept for r in quality_weights(df, labels, keep).collect()}
    wrong = [i for i, _ in rows if got[i] == (i in bad)]
    assert len(wrong) <= 2
    assert got[1000] and got[1001] and got[None]
    kept = keep_quality(df, labels, keep)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in got if got[i]] + ["1"] * got[1])


def test_no_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert keep_quality(docs([(1, "a b"), (2, None)]), none).count() == 2
    assert quality_weights(docs([]), none).count() == 0 and keep_quality(docs([]), none).count() == 0


def test_counts_are_over_all_texts(docs):
    texts = ["a b c a", "x" * 9000, "lo " * 5000, "", "Ä 12 ..!"]
    got = _counts(docs(list(enumerate(texts))).select("text"))
    want = np.zeros_like(got)
    for t in texts:
        for k, b in enumerate(ngrams(t)):
            for x in b:
                want[k][x] += 1
    assert (got == want).all() and got.shape[0] == ORDERS


def test_kth_largest_is_exact(spark, monkeypatch):
    from pricelake.llm import quality

    monkeypatch.setattr(quality, "EXACT_MOST", 20)
    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("key")).cache()
    keys = sorted((r.key for r in df.collect()), reverse=True)
    for k in (1, 2, 500, 2999, 3000):
        assert _kth_largest(df, k) == keys[k - 1]


def by_hand(rows, labels):
    """Weights by dictionaries, one n-gram at a time."""
    def shape(t):
        if t.isalpha():
            return 0 if t.islower() else 1 if t[:1].isupper() and (t[1:].islower() or len(t) == 1) else 2 if t.isupper() else 3
        return 4 if t.isdigit() else 5 + zlib.crc32(t.encode()) % 250

    def grams(t):
        found = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t or "")
        words = [zlib.crc32(x.lower().encode()) for x in found]
        shapes = [shape(x) for x in found]
        shapes = [255 if i and words[i] == words[i - 1] else s for i, s in enumerate(shapes)]
        pair = lambda a, b: ((a * 0x9E3779B1 + b * 0x85EBCA6B) & 0xFFFFFFFF) >> 16
        return [(0, w % BUCKETS) for w in words] + [(1, pair(a, b) % BUCKETS) for a, b in zip(words, words[1:], strict=False)] + [(2, a * 256 + b) for a, b in zip(shapes, shapes[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if labels.get(i):
            target.update(grams(t))
    total = lambda c, k: sum(n for (o, _), n in c.items() if o == k)
    sizes = [(total(raw, k), total(target, k)) for k in range(3)]
    out = []
    for _, t in rows:
        w = 0.0
        for k, b in grams(t):
            n_raw, n_target = sizes[k]
            p = (target[k, b] + 0.5) / (n_target + 0.5 * BUCKETS)
            q = (raw[k, b] * n_target / n_raw + 0.5) / (n_target + 0.5 * BUCKETS)
            w += math.log(p / q)
        out.append(w)
    return out


def test_weights_keys_and_draw_of_every_row(spark, docs):
    rows, bad = corpus(160)
    rows += [(1000, None), (1001, ""), (1002, "word"), (1003, "word"), (1004, "an " * 30_000)]
    marks = {i: i not in bad for i, _ in rows[:120]}
    labels = spark.createDataFrame([(i, int(g)) for i, g in marks.items()], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_weights(docs(rows), labels).collect()}
    weights = dict(zip([i for i, _ in rows], by_hand(rows, marks), strict=True))
    for i, w in weights.items():
        assert got[i].weight == pytest.approx(w, rel=1e-9, abs=1e-9)
    noise = [got[i].key - got[i].weight for i in got]
    assert len(set(noise)) == len(rows) and abs(np.mean(noise) - 0.577) < 0.4 and 0.9 < np.std(noise) < 1.7
    k = round(good_share(sum(marks.values()), len(marks)) * len(rows))
    first = sorted(got, key=lambda i: -got[i].key)[:k]
    assert {i for i in got if got[i].kept} == set(first)


def test_noise_decides_among_equals(spark, docs):
    """Texts of one weight are drawn by the noise alone, half of them; weights that differ little are not a cut either."""
    rows = [(i, "an ther") for i in range(200)] + [(1000 + i, "an ther on") for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 1) for i in range(0, 180, 2)] + [(1, 0)], "doc_id long, quality int")
    got = quality_weights(docs(rows), labels, keep=0.5).collect()
    assert sum(r.kept for r in got) == 200
    by_weight = {r.doc_id for r in sorted(got, key=lambda r: (-r.weight, r.doc_id))[:200]}
    kept = {r.doc_id for r in got if r.kept}
    assert 20 < len(kept - by_weight) < 180
    assert kept == {r.doc_id for r in keep_quality(docs(rows), labels, keep=0.5).collect()}

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pricelake.llm import radix, resampling
from pricelake.llm.common import checkpointed
from pricelake.llm.radix import ranked
from pricelake.llm.resampling import drawn_rows, features, resample

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def bags(text, width=1):
    w = _WORD.findall((text or "").translate(_LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, share=10, of=100, least=20, width=1):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bags(text, width)[1])
    for text in target:
        t.update(bags(text, width)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, text in rows:
        w, f = bags(text, width)
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    fit = sorted((x for x in out if x[5] >= least and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for rank, x in enumerate(fit[: share * len(fit) // of], 1):
        x[4] = rank
    return sorted(str(tuple(x[:5])) for x in out)


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "g4mma", "délta", "ΕΨΙΛΟΝ", "zeta", "x"] + [f"w{i}" for i in range(50)]
    rows = [(i, rng.choice([" ", ", ", "\x00", "--"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in rng.sample(range(-1000, 10**12), n)]
    rows += [(7, None), (8, ""), (None, "alpha " * 30), (9, "alpha " * 30), (10, "beta " * 30000), (2**63 - 1, "alpha zeta " * 15), (-(2**63), "alpha zeta " * 15), (12, "q" * 40000)]
    return rows, [" ".join(rng.choice(words[:20]) for _ in range(30)) for _ in range(50)] + [None, ""]


def got_of(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def test_against_brute_force(spark, docs):
    rows, target = corpus()
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    for width in (1, 2):
        df = docs(rows, extra=["rank", "score", "weight", "text_key", "block", "body"])
        got = resample(df, t, width=width)
        assert got_of(got) == brute(rows, target, width=width)
    kept = drawn_rows(df, got)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.where("rank is not null").collect())


def test_repeated_rows_and_hot_identifier(spark, docs):
    rows, target = corpus(60, 2)
    rows += [(5, "zeta w1 w2 " * 10)] * 200
    t = spark.createDataFrame([(x,) for x in target], "text string")
    assert got_of(resample(docs(rows), t, share=1, of=2)) == brute(rows, target, 1, 2)


def test_empty(spark, docs):
    t = spark.createDataFrame([], "text string")
    assert resample(docs([]), t).count() == 0
    rows = [(i, "a b c " * 9) for i in range(30)]
    assert got_of(resample(docs(rows), t)) == brute(rows, [])
    assert resample(docs([(1, "short")]), t).first()["rank"] is None


def test_texts_are_read_in_stretches(monkeypatch):
    text = " ".join(f"w{i % 97}, é{i}" for i in range(3000))
    monkeypatch.setattr(resampling, "STRETCH", 100)
    got = list(features(text, 3, 10000))
    assert len(got) > 100
    assert Counter(int(x) for _, b in got for x in b) == Counter(bags(text, 3)[1]) and sum(n for n, _ in got) == 6000


def test_radix_sort_is_stable_over_wide_keys(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, 5, rng.randint(-(2**62), 2**62)]), rng.randint(-3, 3), i) for i in range(3000)]
    monkeypatch.setattr(radix, "BLOCK", 64)
    df = checkpointed(spark.createDataFrame(rows, "a long, b long, n long").repartition(3, F.col("n")))
    order = {r.n: i for i, r in enumerate(df.collect())}
    got = [tuple(r) for r in ranked(df, ["a", "b"], ["n"]).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (r[0], r[1], order[r[2]]))
    assert got == [(*r, i) for i, r in enumerate(want, 1)]


def test_one_value_in_every_row(spark):
    df = checkpointed(spark.range(100).selectExpr("7L as a", "id as n"))
    assert [r["rank"] for r in ranked(df, ["a"], ["n"]).orderBy("n").collect()] == list(range(1, 101))

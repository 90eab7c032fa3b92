import random
import re
from itertools import combinations

from pricelake.llm.components import components
from pricelake.llm.near_dedup import keep_one_of_each, near_duplicates


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            ra, rb = root(a), root(b)
            top[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def corpus(seed, n=150):
    rng = random.Random(seed)
    common = ["of", "the", "and", "to", "in", "is"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    texts = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 150, 300]))) for _ in range(n)]

    def changed(t, share):
        return " ".join(word() if rng.random() < share else w for w in t.split())

    for t in list(texts):
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            texts.append(changed(t, rng.choice([0.0, 0.02, 0.05, 0.08, 0.12])))
    big = " ".join(word() for _ in range(200))
    texts += [changed(big, 0.02) for _ in range(60)] + [big.upper()] * 20
    chain = " ".join(word() for _ in range(120))
    for _ in range(12):  # drifts: each like the one before it, the last unlike the first
        chain = changed(chain, 0.04)
        texts.append(chain)
    texts += ["", None, "   ", "Only", "only", "x " * 4000, "x\n" * 4000]
    ids = rng.sample(range(100_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_against_all_pairs(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        got = near_duplicates(docs(rows, extra=["id", "rep", "kept", "n"]), width=2).collect()
        assert sorted(map(tuple, got)) == brute(rows, 2)


def test_five_words_and_kept_rows(docs):
    rows = corpus(4)
    df = docs([*rows, (None, "a b c d e f g"), (None, None)], extra=["id", "rep", "kept", "n", "__x"])
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    want = [i for i, _, _, k in brute(rows, 5) if k]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, want), "None", "None"])


def test_repeated_rows_and_empty_tables(docs):
    t = " ".join(f"w{i}" for i in range(40))
    got = near_duplicates(docs([(5, t), (5, t), (3, t + " z"), (9, t)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (9, 3)]
    assert near_duplicates(docs([])).count() == 0 and keep_one_of_each(docs([])).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (300, 100), (300, 250), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, 250: 100}


def test_contained_pairs_of_frequent_shingles(docs):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(600)]
    wholes = [rng.sample(words, 200) for _ in range(60)]
    texts = [(" ".join(w), " ".join(rng.sample(w, 160))) for w in wholes]
    rows = [(10 * i + k, t) for i, both in enumerate(texts) for k, t in enumerate(both)]
    rows += [(100_000 + i, " ".join(rng.sample(words, 200))) for i in range(100)]  # every word is in some 70 of them
    got = near_duplicates(docs(rows), width=1).collect()
    assert sorted(map(tuple, got)) == brute(rows, 1)
    assert sum(not r.kept for r in got) == len(wholes)


def test_large_group_of_copies_about_the_threshold(docs):
    """Copies whose edits run up to twice what a link with the original allows: many are strays, linked with some others only."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    pool = [word() for _ in range(12)]
    rows = []
    for i in range(400):
        own = list(base)
        for k in rng.sample(range(150), rng.randint(0, 16)):
            own[k] = rng.choice(pool) if rng.random() < 0.5 else word()
        rows.append((i, " ".join(own)))
    got = near_duplicates(docs(rows), width=2).collect()
    want = brute(rows, 2)
    assert sorted(map(tuple, got)) == want
    assert 10 < sum(k for *_, k in want) < 390


def test_values_of_rare_and_of_frequent_lists(docs):
    """Short documents of frequent words only, of all sizes: nothing but whole sets tells them apart."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 40)))) for i in range(400)]
    got = near_duplicates(docs(rows), width=1).collect()
    assert sorted(map(tuple, got)) == brute(rows, 1)

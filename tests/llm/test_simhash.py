import random
import re

import numpy as np
import pytest
import xxhash

from pricelake.llm import simhash
from pricelake.llm.common import WORD, checkpointed
from pricelake.llm.components import components
from pricelake.llm.simhash import allocated, fingerprint, grouped_bits, links, plan, simhash_components

_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def bits_of(text, width=3):
    w = re.findall(WORD, (text or "").translate(_LOWER))
    if not w:
        return 0
    got = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in got) > len(got))


def reached(values, distance):
    """value -> the least value of its component."""
    values, seen = sorted(set(values)), {}
    for v in values:
        if v in seen:
            continue
        todo, seen[v] = [v], v
        while todo:
            x = todo.pop()
            for y in values:
                if y not in seen and bin(x ^ y).count("1") <= distance:
                    seen[y] = v
                    todo.append(y)
    return seen


def brute(rows, distance=2):
    bits = [(i, bits_of(t)) for i, t in rows]
    of = reached([b for _, b in bits], distance)
    least = {}
    for i, b in bits:
        if i is not None:
            least[of[b]] = min(least.get(of[b], i), i)
    return sorted(str((i, f"{b:016x}", least.get(of[b]))) for i, b in bits)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Straße", "uno", "DOS", "tres", "x"]) + str(rng.randint(0, 40))
    rows = []
    for i in rng.sample(range(-500, 10**9), n):
        rows.append((i, rng.choice([" ", "\t", "\n  "]).join(word() for _ in range(rng.randint(0, 90)))))
    long = [word() for _ in range(2500)]
    rows += [(5000 + i, " ".join([*long[:i], "new", *long[i + 1 :]])) for i in range(0, 150)]
    return rows + [(1, None), (2, ""), (3, " \n"), (None, "uno"), (None, "only here, no name"), (4, "uno dos"), (5, "UNO dos"), (6, "x " * 50000), (7, "q" * 60000), rows[0], (rows[1][0], rows[2][1])]


def test_against_brute_force(docs):
    rows = corpus()
    got = simhash_components(docs(rows, extra=["bits", "fingerprint", "component", "least"]))
    out = got.collect()
    assert sorted(str(tuple(r)) for r in out) == brute(rows)
    assert len({r.component_id for r in out}) < len({r.fingerprint for r in out})


def test_stretches_do_not_matter(monkeypatch):
    texts = [t for _, t in corpus(40)]
    want = [bits_of(t) for t in texts]
    for stretch in (1, 7, 1 << 20):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        assert [fingerprint(t) for t in texts] == want
        assert [fingerprint(t, 1) for t in texts[:9]] == [bits_of(t, 1) for t in texts[:9]]


def test_empty(docs):
    assert simhash_components(docs([])).count() == 0
    assert [tuple(r) for r in simhash_components(docs([(None, None)])).collect()] == [(None, "0" * 16, None)]


def cloud(seed, groups=40, each=30, skewed=False):
    """Fingerprints in groups of near ones; skewed: some bits hardly ever change, some go together."""
    rng, out = random.Random(seed), set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        if skewed:
            x = x & ~0xFFFFFF | (0xFFF000 if x & 1 else 0)
        for _ in range(rng.randint(1, each)):
            out.add(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("short", [2, 64])
@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("skewed", [False, True])
def test_links_lose_no_component(spark, monkeypatch, short, distance, skewed):
    monkeypatch.setattr(simhash, "SHORT", short)
    values = cloud(11, skewed=skewed)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = checkpointed(spark.createDataFrame([(x,) for x in signed.values()], "bits long"))
    got = {r.node: r.component for r in components(links(df, distance)).collect()}
    of = reached(values, distance)
    groups = {}
    for v in values:
        groups.setdefault(of[v], set()).add(got.get(signed[v], signed[v]))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_are_unequal_where_partitions_are(spark):
    # 32 bits never change: a partition of them tells nothing, and is left out.
    rng = random.Random(5)
    values = [rng.getrandbits(32) << 32 for _ in range(4000)]
    df = checkpointed(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long"))
    got = plan(df, 2)
    assert all(not set(part) <= set(range(32)) for part, _ in got)
    exact = {m: sum(int(c) ** 2 for c in np.unique(np.array(values, dtype=np.uint64) & np.uint64(m), return_counts=True)[1]) for m in (0xFFF << 32, 0xFFFFF << 40)}
    for m, estimate in zip(exact, simhash.moments(df, list(exact)), strict=True):
        assert abs(estimate - exact[m]) < 0.25 * exact[m]


def test_allocation_is_the_cheapest():
    rng = random.Random(8)
    for _ in range(50):
        costs = [{t: rng.random() for t in (-1, 0, 1)} for _ in range(4)]
        every = [([a, b, c, d], costs[0][a] + costs[1][b] + costs[2][c] + costs[3][d]) for a in costs[0] for b in costs[1] for c in costs[2] for d in costs[3] if a + b + c + d == -1]
        assert allocated(costs, -1)[0] == pytest.approx(min(c for _, c in every))


def test_correlated_bits_go_together():
    phi = np.eye(64)
    for k in range(0, 64, 4):
        phi[k, (k + 32) % 64] = phi[(k + 32) % 64, k] = 0.9
    parts = grouped_bits(phi, 2)
    assert sorted(b for p in parts for b in p) == list(range(64)) and all((k in p) == ((k + 32) % 64 in p) for p in parts for k in range(0, 64, 4))

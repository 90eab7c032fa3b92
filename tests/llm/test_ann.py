import numpy as np
import pytest

from pricelake.llm import ann
from pricelake.llm.ann import CentroidGraph, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.asarray(v, np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.7 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    want, got = brute(rows), answers(nearest_neighbours(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(np.sqrt(((np.array(rows[q][1]) - np.array(rows[i][1])) ** 2).sum()), abs=1e-12)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))


def test_ties_equal_vectors_and_bad_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 400)] + [(400, [9.0, 9.0, 9.0]), (500, [8.0, 9.0, 9.0])]
    bad = [(600, None), (700, [0.0, 0.0, 0.0]), (800, [float("nan"), 1.0, 1.0]), (900, [None, 1.0, 1.0]), (1000, [float("inf"), 1.0, 1.0]), (None, same), (1100, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad + rows[:3]], SCHEMA).withColumnRenamed("label", "list")
    got = answers(nearest_neighbours(df))
    assert got == brute(rows)
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[200]] == list(range(10))


def test_few_and_none(spark):
    assert answers(nearest_neighbours(spark.createDataFrame([(100, [1.0], 0), (3, [4.0], 0)], SCHEMA))) == {100: [(3, 3.0)]}
    assert nearest_neighbours(spark.createDataFrame([(100, [1.0], 0)], SCHEMA)).count() == 0
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    c, x = rng.normal(size=(500, 8)), rng.normal(size=(60, 8))
    ids, dist = CentroidGraph.of(c).nearest(x, 16)
    true = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    order = np.argsort(true, 1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, order, strict=True)]) > 0.95
    assert np.allclose(np.take_along_axis(true, ids, 1), dist)
    assert all(len(set(r)) == len(r) for r in ids.tolist())


def test_outlier_queries_find_k(spark):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(6000, 16))
    far = np.arange(0, 6000, 100)
    vecs[far] = 60 * rng.normal(size=(60, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vecs)]
    want, got = brute(rows), answers(nearest_neighbours(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    assert want.keys() == got.keys()
    assert all(len(x) == 10 for x in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * 600


def test_lists_that_outgrow_the_centroids_are_divided(spark, monkeypatch):
    """As if the table were a hundred times larger: eight centroids at the top, all further ones below them."""
    for name, value in (("CENTROIDS_MOST", 8), ("SPLIT_SIZE", 600), ("BELOW_MOST", 8), ("DEALT", 500)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    vecs = (centres[rng.integers(0, 40, 16_000)] + 0.5 * rng.normal(size=(16_000, 16))).astype(np.float32)
    vecs[5000:8000] = vecs[5000] + 1e-4 * rng.normal(size=(3000, 16))  # no centroid divides these
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], SCHEMA).withColumnRenamed("label", "ids")
    got = answers(nearest_neighbours(df))
    hits = total = 0
    for q, found in got.items():
        d = ((vecs.astype(float) - vecs[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for i, _ in found})
        total += 10
    assert len(got) == 160 and all(len(x) == 10 for x in got.values()) and hits >= 0.9 * total


def test_several_hundred_lists(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(80, 32))
    vecs = centres[rng.integers(0, 80, 40_000)] + 0.5 * rng.normal(size=(40_000, 32))
    vecs[:4000:100] *= 40  # far-off queries besides ordinary ones
    vecs = vecs.astype(np.float32)
    got = answers(nearest_neighbours(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], SCHEMA)))
    assert len(got) == 400 and all(len(x) == 10 for x in got.values())
    hits = {True: 0, False: 0}
    for q, found in got.items():
        d = ((vecs.astype(float) - vecs[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits[q < 4000] += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for i, _ in found})
    assert hits[True] >= 0.95 * 400 and hits[False] >= 0.95 * 3600

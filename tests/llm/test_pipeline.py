import random
from collections import defaultdict

import numpy as np
from test_exact_packing_tokens import BYTE, crc, ids
from test_near_dedup import brute as near_brute
from test_substring_dedup import brute as repeats_brute

import corpus_pipeline
from pricelake.llm.quality import quality_weights


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on", "in", "es", "re"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, rows, bad = text(70), [], []
    for i in range(200):
        t = text(rng.randint(5, 120))
        if i % 9 == 0:
            bad.append(i)
            t = " ".join(f"{w.upper()}!!" for w in t.split())
        elif i % 7 == 0:
            t = f"{t} {passage} {text(9)}"
        rows.append((i, t))
    rows += [(1000 + i, rows[i][1]) for i in range(1, 40)]
    for i in range(40, 80):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((2000 + i, " ".join(w)))
    return [*rows, (3000, None), (3001, ""), (None, text(30))], bad


def test_every_stage_against_brute_force(spark, docs, tmp_path):
    rows, bad = corpus()
    at = str(tmp_path)
    docs(rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    df, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, at).write.parquet(f"{at}/{name}")
        df = spark.read.parquet(f"{at}/{name}")
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out[name] = [(r.doc_id, r.text) for r in df.collect()]
    by = lambda x: sorted(map(str, x))
    clean = {i for i, _ in rows} - set(bad) - {1000 + i for i in bad} - {2000 + i for i in bad}
    drawn = {r.doc_id for r in quality_weights(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).where("kept").collect()}
    assert by(out["quality"]) == by((i, t) for i, t in rows if i in drawn)  # test_quality.py holds that draw against counts by hand
    assert len(clean - drawn) <= 2 and len(set(bad) & drawn) <= 6  # one standard error of the labelled share more than are good
    largest = defaultdict(list)
    for i, t in out["quality"]:
        largest[t or ""].append((i is not None, i or 0, i, t))
    assert by(out["exact"]) == by(max(own)[2:] for own in largest.values())
    known = [(i, t) for i, t in out["exact"] if i is not None]
    keep = {i for i, _, _, k in near_brute(known, 5) if k} | {None}
    assert by(out["near"]) == by((i, t) for i, t in out["exact"] if i in keep)
    cut = repeats_brute(out["near"], 50)
    assert by(out["substring"]) == by((i, kept if gone else t) for (i, t), (_, _, gone, kept) in zip(out["near"], cut, strict=True))
    assert sum(gone for _, _, gone, _ in cut) > 500
    texts = {i: ids(BYTE, t, 0) for i, t in out["substring"]}
    pieces = defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append((r.start, r.length))
        assert r.ids_crc32 == crc(texts[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(texts[r.doc_id])
    for i, own in texts.items():
        covered = np.zeros(len(own), int)
        for a, n in pieces[i]:
            covered[a : a + n] += 1
        assert (covered == 1).all()
    again = corpus_pipeline.run(spark, at).select("doc_id", "start", "length", "ids_crc32")
    total = lambda x: sorted((str(r.doc_id), r.doc_tokens) for r in x.select("doc_id", "doc_tokens").distinct().collect())
    assert total(corpus_pipeline.run(spark, at)) == total(df) and again.count() > 0


def test_empty_documents(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_long_texts_and_repeated_rows(spark, docs, tmp_path):
    extra = ["row", "key", "ord", "id", "rep", "set", "chunk", "kept", "weight", "bucket", "__gone", "star"]
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    rows = [(i, " ".join(f"a{i * 7 + k}" for k in range(60))) for i in range(30)] + [(100, long), (101, long + " end"), (5, None), (5, None), (None, "x y z")]
    docs(rows, extra=extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = df.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert df.columns == names and {r["row"] for r in df.select("row").collect()} == {"mine"}
    left = {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert left == {*range(30), 100, None}

"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelake.llm.common import checkpointed, scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, threshold=0.8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.packing import pack, piece_digests

    return piece_digests(pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=0))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.flat_tokens import count_flat, counts_by_document, write_flat

    folder, separator = scratch(spark, "flat-tokens"), 49407
    manifest = checkpointed(write_flat(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), separator))
    return counts_by_document(count_flat(spark, folder, separator), manifest)


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.token_files import read_orc, with_crc32, write_orc

    path = scratch(spark, "token-orc")
    write_orc(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return with_crc32(read_orc(spark, path))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.exact_dedup import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.substring_dedup import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"), window=50)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.sentencepiece_codec import decode, digests, encode

    model = tokenizer_path("piece_bpe_32k.model")
    return digests(decode(encode(table(spark, sf_dir, "documents"), model), model))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), is_query="vec_id % 100 = 0", k=10)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.quality import quality_weights

    return quality_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.resampling import resample

    ranks = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=10, of=100, least_words=20)
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), width=3, distance=2)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelake.llm.periodic import planted, repeated_runs, run_digests

    return run_digests(repeated_runs(table(spark, sf_dir, "documents"), planted, least=6, times=4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_token_orc": op8_token_orc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_resampling": op11_resampling,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

#: The words of each text (a null has none), as they are and with A-Z in lower case.
_WORDS = r"""WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
lowered AS (SELECT doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM texts)"""

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": _WORDS
    + """, sets AS (
          SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM lowered),
        entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.x = b.x AND a.doc_id != b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)""",
    "op5_nearest_neighbours": """
        WITH vectors AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 10""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_substring_dedup": _WORDS
    + """, windows AS (
          SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)),
        late AS (SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS first FROM windows GROUP BY h) USING (h) WHERE doc_id > first),
        gone AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(i, i + 50)) AS place FROM late)),
        kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts)
          ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    # The CRC's table follows from its polynomial; each distinct word is coded once.
    "op11_resampling": r"""
        WITH entries AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)),
        crc AS (SELECT list(c ORDER BY i) AS t FROM entries),
        texts AS (
          SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
          UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        features AS (SELECT side, doc_id, unnest(w) AS word FROM texts),
        bytes AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS x FROM (SELECT DISTINCT word FROM features)),
        coded AS (SELECT word, xor(list_reduce(x, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc),
        counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features JOIN coded USING (word) GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
        gains AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS gain FROM counts, totals),
        weighed AS (SELECT doc_id, floor(sum(gain) / count(*)) AS weight FROM features JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
        scored AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                 CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
          FROM texts LEFT JOIN weighed USING (doc_id) WHERE side = 'd'),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20 AND doc_id IS NOT NULL) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND doc_id IS NOT NULL AND place <= 10 * n // 100 THEN place END AS rank FROM ordered""",
}

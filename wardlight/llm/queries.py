"""Queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, centroids, itq, lz_dedup, lz_fingerprint, mixing, quality_model, quality_rules, secret_scan, simhash, token_files, toxicity
from .text import documents, scratch


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "fail_bits")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(documents(spark, sf_dir))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lz_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write(documents(spark, sf_dir), folder)
    return token_files.digests(spark, folder)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.agreement(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_simhash_dedup, op3_toxicity, op4_lz_fingerprint, op5_bpe, op6_mixing, op7_secret_scan, op8_quality_model, op9_lz_dedup, op10_token_files, op11_centroids, op12_itq_dedup, op13_alignment, pipeline)
    return {f.__name__: f for f in ops}


_WORD = r"[^\x20\x09-\x0D]"

OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM documents
), g AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS five FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN repeats USING (r)
), b AS (
  SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {quality_rules.BITS[name]} ELSE 0 END" for name, rule in quality_rules.RULES)})::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  fail_bits & {quality_rules.mask("v2")} = 0 AS kept, n_lines, n_upper, fail_bits FROM b
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, coalesce(len(regexp_extract_all(text, '{_WORD}+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), f AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE weight END AS w, 2 * source_size / weight AS fill FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(2 * source_size) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM f
), v AS (
  SELECT *, CASE WHEN w > 0 THEN (1.5::DOUBLE * total - before) / open END AS level FROM c
), x AS (
  SELECT (SELECT level FROM v WHERE level <= fill ORDER BY fill, source NULLS LAST LIMIT 1) AS level
), g AS (
  SELECT source, source_size, CASE WHEN w = 0 THEN 0::DOUBLE ELSE coalesce(least(x.level * w, (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) END AS target FROM v, x
), k AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS rank,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * (floor(rank * (target / source_size) + u) - floor((rank - 1) * (target / source_size) + u))::BIGINT END AS taken
FROM k
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS span FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)
), later AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY md5(span) ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS p FROM later
), lists AS (
  SELECT r, list(p) AS p FROM gone GROUP BY r
), words AS (
  SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT words.r, string_agg(x, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(lists.p), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""




def _op11_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS, dims: int = centroids.DIMS) -> str:
    """Plain k-means over lists of integers, each round in two steps of its own."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM (SELECT v.r, v.vec_id, v.q, c.c, {far} AS d FROM v, c{i} c)) WHERE n = 1)")
        if i < rounds:
            mean = f"(SELECT c, list(m ORDER BY i) AS q FROM (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT c, unnest(q) AS x, unnest(range({dims})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN {mean} m ON m.c = o.c)")
    a = f"a{rounds}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, {a}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY {a}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(e.q, ',')) AS centroid_sha256
FROM {a} JOIN c{rounds} e ON e.c = {a}.c"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": _op11_sql(), "op1_quality_rules": OP1_SQL, "op6_mixing": OP6_SQL, "op9_lz_dedup": OP9_SQL}

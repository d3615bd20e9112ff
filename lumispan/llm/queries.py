"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispan.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.rans import encoded_documents

    return encoded_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.warc import read_warc, write_warc

    index = write_warc(table(spark, sf_dir, "pages"), min_bytes=0)
    return read_warc(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.chunkbpe import round_trip_hashes

    return round_trip_hashes(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.graphdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.toxicity import severities

    return severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.packing import pack_tokens

    return pack_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.linededup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op10_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.fingerprint import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.dualtree import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.dimscan import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumispan.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, one pair of subqueries each; integer division rounds towards zero, so remainders are taken off first."""
    steps = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v FROM e WHERE vec_id IS NOT NULL QUALIFY k < {k})"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT e.id, min({{'d': list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': c.k}}) AS b FROM e, c{i} c GROUP BY e.id)")
        if i < rounds:
            steps.append(
                f"s{i} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.b.k AS k, unnest(e.v) AS x, unnest(range(len(e.v))) AS i FROM a{i} a JOIN e ON e.id = a.id) GROUP BY k, i), "
                f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY k), "
                f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)"
            )
    head = "e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
    return f"""
WITH {head}, {', '.join(steps)},
r AS (SELECT e.vec_id, CAST(a.b.k AS INT) AS cluster, CAST(a.b.d AS BIGINT) AS distance FROM a{rounds} a JOIN e ON e.id = a.id)
SELECT r.vec_id, r.cluster, r.distance, CAST(sum(r.distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(r.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM r JOIN c{rounds} c ON c.k = r.cluster"""


QUERIES = {"op1_rans_tokens": op1_rans_tokens, "op2_warc": op2_warc, "op3_chunk_bpe": op3_chunk_bpe, "op4_vector_graph": op4_vector_graph, "op5_jaccard_join": op5_jaccard_join, "op6_language_id": op6_language_id, "op7_toxicity": op7_toxicity, "op8_harmonic_packing": op8_harmonic_packing, "op9_fuzzy_lines": op9_fuzzy_lines, "op10_prefix_fingerprints": op10_prefix_fingerprints, "op11_dual_tree": op11_dual_tree, "op12_dimension_scan": op12_dimension_scan, "op13_whitening": op13_whitening}

ORACLE_SQL = {
    "op11_dual_tree": _lloyd_sql(),
    # the search is exact as long as there is one list, as on small tables
    "op12_dimension_scan": """
WITH e AS (SELECT row_number() OVER () AS id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS own, a.vec_id AS query_id, b.vec_id, b.id, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 5""",
    "op4_vector_graph": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT DISTINCT u AS id, u AS reached FROM l UNION SELECT r.id, l.w FROM r JOIN l ON l.u = r.reached),
c AS (SELECT id, min(reached) AS component FROM r GROUP BY id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(c.component, m.vec_id) AS BIGINT) AS component_id, m.vec_id = coalesce(c.component, m.vec_id) AS kept
FROM embeddings m LEFT JOIN n ON n.u = m.vec_id LEFT JOIN c ON c.id = m.vec_id""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits,
      min(page_id) OVER (PARTITION BY sha1(html)) AS lead FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM d""",
}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

"""Registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return put


#: DuckDB twins of the shared text rules.
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query("op10_exact_dedup", f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS pts, sha256({_NORM}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY pts DESC, doc_id NULLS LAST) AS keep_id
      FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)""")
def op10_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


@query("op7_curriculum_mix")
def op7_curriculum_mix(spark, sf_dir):
    from .curriculum_mix import curriculum_mix
    return curriculum_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "positions")


@query("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    from .url_filter import url_filter
    return url_filter(table(spark, sf_dir, "pages"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    from .substring_dedup import substring_dedup
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import suffix_dedup
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op2_embedding_neardup")
def op2_embedding_neardup(spark, sf_dir):
    from .embedding_neardup import embedding_neardup
    return embedding_neardup(table(spark, sf_dir, "embeddings"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    from .byte_bpe import RANKS, byte_bpe
    return byte_bpe(table(spark, sf_dir, "documents"), P.path(RANKS), P.PATTERN, with_ids=False).drop("tokens")


@query("op3_language_mixture")
def op3_language_mixture(spark, sf_dir):
    from .language_mixture import language_mixture
    return language_mixture(table(spark, sf_dir, "documents"))


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark, sf_dir):
    from .ngram_jaccard import ngram_jaccard
    return ngram_jaccard(table(spark, sf_dir, "documents"))


@query("op1_token_counts", f"""
WITH c AS (SELECT doc_id, {_SIZE} AS n FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, n AS n_tokens,
       CAST(coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           AS token_start
FROM c""")
def op1_token_counts(spark, sf_dir):
    from .token_counts import document_token_counts
    return document_token_counts(table(spark, sf_dir, "documents"))


def _op11_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """The rounds written out: every vector against every centroid, in integers."""
    sql = f"""
WITH cells AS (SELECT r, vec_id, d, x FROM
  (SELECT row_number() OVER () AS r, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
   FROM embeddings WHERE len(embedding) = {dim})),
ok AS (SELECT r FROM cells GROUP BY r HAVING count(*) FILTER (x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) = {dim}),
v AS MATERIALIZED (SELECT r, vec_id, d, CAST(floor(64.0::DOUBLE * x::DOUBLE) AS BIGINT) AS x FROM cells SEMI JOIN ok USING (r)),
pick AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM (SELECT DISTINCT r, vec_id FROM v)
         WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, d, x FROM pick JOIN v USING (r))"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT r, first(cluster ORDER BY dist, cluster) AS cluster, min(dist) AS dist FROM
   (SELECT r, cluster, sum((v.x - c{i}.x) * (v.x - c{i}.x)) AS dist FROM v JOIN c{i} USING (d) GROUP BY r, cluster) GROUP BY r)"""
        if i < rounds:
            sql += f""",
s{i} AS (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY cluster, d),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, c{i}.d,
   CASE WHEN n IS NULL THEN c{i}.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{i} LEFT JOIN s{i} USING (cluster, d))"""
    return sql + f""",
h AS (SELECT cluster, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster),
ids AS (SELECT DISTINCT r, vec_id FROM v)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
       centroid_sha256, count(*) OVER (PARTITION BY cluster) AS cluster_size
FROM a{rounds} JOIN ids USING (r) JOIN h USING (cluster)"""


@query("op11_centroid_clustering", _op11_sql())
def op11_centroid_clustering(spark, sf_dir):
    from .centroid_clustering import centroid_clustering
    return centroid_clustering(table(spark, sf_dir, "embeddings"))


@query("op12_secret_scan")
def op12_secret_scan(spark, sf_dir):
    from .secret_scan import secret_scan
    return secret_scan(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    from .spelling_variants import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)

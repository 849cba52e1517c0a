"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The model whose tokens are counted.
TOKEN_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Host and path rules with their verdicts.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    from lineage_jobs.llm.tokens import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKEN_MODEL), TOKEN_LIMIT)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds most of a benchmark item, with that item."""
    from lineage_jobs.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from lineage_jobs.llm.urls import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    from lineage_jobs.llm.toxicity import fit_toxicity, toxicity_scores

    documents = _table(spark, sf_dir, "documents")
    return toxicity_scores(documents, fit_toxicity(documents, _table(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line of every document, and whether the line is kept."""
    from lineage_jobs.llm.lines import line_duplicates

    return line_duplicates(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    from lineage_jobs.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    from lineage_jobs.llm.shards import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a document, with its text, in the mixture of sources weighted by the square root of their bytes,
    globally shuffled."""
    from lineage_jobs.llm.mixing import mix_sources, shuffled

    return shuffled(mix_sources(_table(spark, sf_dir, "documents"), columns=["doc_id", "source", "text"]))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, filed by source, language and thousand; even ids one directory higher."""
    from lineage_jobs.llm.licenses import license_scan

    folder = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("/", "source", "lang")).otherwise(
        F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"))
    )
    documents = _table(spark, sf_dir, "documents")
    return license_scan(documents.withColumn("path", F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its likeness to an edited text's and the next document's."""
    from lineage_jobs.llm.fingerprints import edit_likeness

    return edit_likeness(_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    from lineage_jobs.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every embedding and its error."""
    from lineage_jobs.llm.codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    from lineage_jobs.llm.whitening import whitened_embeddings

    return whitened_embeddings(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the whole pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this module: those named opN_... and the pipeline."""
    return {name: f for name, f in globals().items() if (name.startswith("op") and callable(f)) or name == "pipeline"}


OP8_SQL = """
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0)) AS n_bytes FROM documents GROUP BY source),
w AS (SELECT sum(sqrt(n_bytes)) AS raw, sum(n_bytes) AS b FROM s),
r AS (SELECT source, CASE WHEN n_bytes > 0 THEN sqrt(n_bytes) / raw * b / n_bytes ELSE 0 END AS rate FROM s, w),
steps AS (SELECT source, k, exp(-rate + k * ln(rate) - ln(gamma(k + 1))) AS p
          FROM r, range(0, 101) AS g(k) WHERE rate > 0),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
d AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents),
n AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf WHERE cdf.source = d.source AND cdf.c <= d.u) AS n FROM d)
SELECT n.doc_id, n.source, n.text, CAST(copy AS INTEGER) AS copy,
       md5('0:' || CAST(n.doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS place
FROM n, range(1, n.n + 1) AS g(copy)
"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
      ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS v(h, q, rule, verdict)),
m AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
      row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_of FROM m WHERE n = 1
"""


#: Each round's codebooks, then the codes; vectors of 64 components, as in the given tables.
_ASSIGNED = """SELECT t.vec_id, t.p, t.v,
  arg_min(b.e, (list_inner_product(t.v, t.v) - 2 * list_inner_product(t.v, b.v) + list_inner_product(b.v, b.v)) * 256 + b.e) AS e,
  min(list_inner_product(t.v, t.v) - 2 * list_inner_product(t.v, b.v) + list_inner_product(b.v, b.v)) AS far
  FROM parts t JOIN book{k} b ON b.p = t.p GROUP BY t.vec_id, t.p, t.v"""
_MOVED = """book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
  SELECT p, e, list(f ORDER BY j) AS v FROM (SELECT p, e, j, floor(sum(v[j]) / count(*)) AS f FROM near{k}, range(1, 17) AS g(j) GROUP BY p, e, j) GROUP BY p, e
  ) m ON m.p = b.p AND m.e = b.e)"""
OP12_SQL = (
    """WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, x[p * 16 + 1 : p * 16 + 16] AS v FROM kept, range(4) AS g(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN first USING (vec_id)),
"""
    + "".join(f"near{k} AS MATERIALIZED ({_ASSIGNED.format(k=k)}),\n{_MOVED.format(k=k, n=k + 1)},\n" for k in range(4))
    + f"""near4 AS MATERIALIZED ({_ASSIGNED.format(k=4)}),
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(v[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM book4, range(1, 17) AS g(j)) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""
)


def oracle_sql() -> dict[str, str]:
    """OP3_SQL holds for pages without canonical or redirect links, as in the given tables."""
    import corpus_pipeline

    found = {"op3_url_filter": OP3_SQL, "op8_source_mix": OP8_SQL, "op12_vector_codes": OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

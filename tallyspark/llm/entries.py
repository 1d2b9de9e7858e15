"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bitslice, fixity, html_text, mixing, packing, pii, quality, secret_scan, simhash, vector_join

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
QUALITY_LEAST = 0.3
MIX_SEED = 42
MIX_EXPONENT = 0.5
PAGES_PER_FILE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.training_model(docs, table(spark, sf_dir, "labels"))
    scores = docs.select("doc_id", quality.held_out().alias("held_out"), quality.scored(model, F.col("text")).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= QUALITY_LEAST).cast("int"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files of 256 records, against a replica in which some records are lost or altered."""
    pages = table(spark, sf_dir, "pages")
    record = fixity.warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    file = F.floor(F.col("page_id") / PAGES_PER_FILE)
    fate = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    replica = pages.where(fate != "00").withColumn("html", F.when(fate <= "03", F.concat(F.lit("X"), "html")).otherwise(F.col("html")))
    return fixity.audit(*[fixity.laid_out(side, file, ["page_id"], record, "page_id") for side in (pages, replica)])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return secret_scan.span_columns(found, [r.kind for r in secret_scan.BASE], ["n_assign", "n_access", "n_hex"])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return secret_scan.span_columns(found, list(pii.BASE_KINDS), ["n_email", "n_ip", "n_card", "n_phone"])


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED, exponent=MIX_EXPONENT)
    return mixed.select("doc_id", "copy", "source", "lang", "text", "n_chars")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op9_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_best_fit_packing,
        op2_compression_quality,
        op3_merkle_fixity,
        op4_secret_scan,
        op5_personal_data,
        op6_poisson_mixing,
        op7_main_text,
        op8_near_vectors,
        op9_bit_sliced_top_k,
        op10_simhash,
    )
    return {f.__name__: f for f in own}


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen({html}) || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10)"""


def oracle_sql() -> dict[str, str]:
    own, other = (_RECORD.format(html=x) for x in ("coalesce(html, '')", "CASE WHEN fate <= '03' THEN 'X' || html ELSE coalesce(html, '') END"))
    return {
        "op3_merkle_fixity": f"""
WITH leaves AS (
  SELECT page_id // {PAGES_PER_FILE} AS file, page_id AS record_id, substr(md5(page_id::VARCHAR), 1, 2) AS fate, sha256({own}) AS expected_hash, strlen({own}) AS length
  FROM pages),
replica AS (
  SELECT page_id, CASE WHEN fate = '00' THEN '' ELSE sha256({other}) END AS found_hash
  FROM (SELECT *, substr(md5(page_id::VARCHAR), 1, 2) AS fate FROM pages))
SELECT file::BIGINT AS file, record_id, "offset", length, expected_hash, found_hash, CASE WHEN found_hash = '' THEN 'missing' ELSE 'altered' END AS status
FROM (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY record_id) - length)::BIGINT AS "offset" FROM leaves) JOIN replica ON page_id = record_id
WHERE expected_hash <> found_hash""",
        "op6_poisson_mixing": f"""
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(n, {MIX_EXPONENT}) / (SELECT sum(pow(n, {MIX_EXPONENT})) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
mass AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass),
drawn AS (SELECT *, ('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents),
times AS (SELECT d.doc_id, count(c.k) AS n FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, unnest(generate_series(1, t.n))::INT AS copy, d.source, d.lang, d.text, d.n_chars FROM documents d JOIN times t USING (doc_id)""",
        "op8_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low ON low.a = vec_id""",
        "op9_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    }

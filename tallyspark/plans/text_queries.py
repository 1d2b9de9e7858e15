"""Registered queries on texts, retrieval and evaluation, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import evaluation, retrieval, texts
from tallyspark.sources.panel import read
from tallyspark.streaming.sessions import fold_sessions

K = 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a question."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(documents(spark, sf_dir), questions(spark, sf_dir), K, cjk=False).select("qid", "doc_id", "score", "rank")


def second_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel with candidates of its own among all documents: those that share most distinct tokens, in place of vectors of texts."""
    return retrieval.keyword_overlap(documents(spark, sf_dir), questions(spark, sf_dir), 6)


def fuse(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        channels = {"bm25": bm25_topk(spark, sf_dir), "vector": second_channel(spark, sf_dir)}
        out = retrieval.fused(channels, how)
        return out.select("qid", "doc_id", "score", "rank", F.round(F.col("score_detail")["bm25"], 6).alias("bm25"), F.round(F.col("score_detail")["vector"], 6).alias("vector"))

    return run


def with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")


def doc_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.quota(with_source(spark, sf_dir), 2, group="source").select("qid", "doc_id", "source", "rank")


def filtered_else_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.filtered_else_all(with_source(spark, sf_dir), F.col("lang") == "de").select("qid", "doc_id", "lang", "rank")


def rerank_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(bm25_topk(spark, sf_dir), None, 5)


def reranked_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("rerank"))
    score = lambda found: found.select("qid", "doc_id").join(lengths, "doc_id")
    return retrieval.reranked(bm25_topk(spark, sf_dir), score, 5).select("qid", "doc_id", "rank", "rerank")


def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.interleaved([bm25_topk(spark, sf_dir), second_channel(spark, sf_dir)])


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_overlap(documents(spark, sf_dir), questions(spark, sf_dir), 5)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return retrieval.dense(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 8)


def tokenize_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = retrieval.postings(documents(spark, sf_dir), "doc_id", "text", cjk=False)
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents of a question: those that hold its whole passage."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return texts.holding(documents(spark, sf_dir), b)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_metrics(bm25_topk(spark, sf_dir), golden(spark, sf_dir), 5)


def recall_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_ceiling(golden(spark, sf_dir), 5, 2)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_interval(read(spark, sf_dir, "labels"), "quality", "doc_id")


def status_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("kind"))
    return evaluation.crosstab(e, "event_type", "kind")


def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    verdict = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie"), F.lit("??")), (F.col("event_id") % 4 + 1).cast("int"))
    return evaluation.win_rates(e.select("event_type", verdict.alias("verdict"), (F.col("user_id") % 2 == 0).alias("swapped")), "event_type")


def executability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "boom").alias("error"), (F.col("event_id") % 5 == 0).alias("asks"), (F.col("event_id") % 3 != 0).alias("ran"), (F.col("user_id") % 4).alias("n"))
    return e.groupBy(evaluation.executability(e, "n", "error", "asks", "ran").alias("status")).agg(F.count("*").alias("n"))


def slot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a document's near ids against those with two swapped or one changed."""
    d = documents(spark, sf_dir)
    mk = lambda a, b: F.array(F.col(a), F.col(b))
    want = d.select(F.col("doc_id").alias("id"), mk("source", "lang").alias("metrics"), F.array("lang").alias("years"))
    got = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("id"), mk("lang", "source").alias("metrics"), F.array(F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang"))).alias("years"))
    compared = evaluation.slot_differences(want, got, ["metrics", "years"])
    return compared.select("id", F.array_join("differs", ",").alias("differs"))


def golden_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels, over which those of poor and of toxic documents are set anew; a toxic document's list is empty."""
    l = read(spark, sf_dir, "labels")
    old = l.select(F.col("doc_id").alias("qid"), F.array("quality").alias("relevant"))
    new = l.where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("qid"), F.when(F.col("toxic") == 1, F.array().cast("array<int>")).otherwise(F.array("quality", "toxic")).alias("relevant"))
    return evaluation.merged_labels(old, new).select("qid", F.array_join(F.transform("relevant", lambda x: x.cast("string")), ",").alias("relevant"))


def review_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shortlist(bm25_topk(spark, sf_dir), golden(spark, sf_dir), 3)


def label_judge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_topk(spark, sf_dir)
    return evaluation.judge_counts(found.where("rank <= 3"), golden(spark, sf_dir), found)


def effective_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", evaluation.effective_quota(F.col("n_nationkey") % 5, F.col("n_regionkey")).alias("quota"))


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.concat_ws("\n", F.concat(F.lit("# "), F.col("source")), "text", F.concat(F.lit("## "), F.col("lang")), "text").alias("text"))
    return texts.sections(d).select("doc_id", F.col("section_no").cast("int").alias("section_no"), "section_title", F.md5(F.col("text").cast("binary")).alias("tag"))


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.concat_ws("\n", F.lit("head"), F.concat(F.lit("| "), F.col("source"), F.lit(" | "), F.col("lang"), F.lit(" |")), F.lit("| --- | --- |"), F.concat(F.lit("|"), F.col("n_chars").cast("string"), F.lit("| x |")), F.lit("end"), F.lit("| z |")).alias("text"))
    return texts.pipe_tables(d).select("doc_id", "table_index", F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), ";").alias("cells"))


def text_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines built around the documents: only key lines and the tables of kept sections stay."""
    d = documents(spark, sf_dir).select(
        "doc_id",
        F.concat_ws("\n", F.lit("# 利润表"), F.concat(F.lit("| "), F.col("source"), F.lit(" |")), F.col("lang"), F.lit("# 释义"), F.concat(F.lit("| "), F.col("lang"), F.lit(" |")), F.lit("净利润 1"), F.lit("# 其他"), F.lit("| 项目 | 1 |"), F.lit("| x | 1 |")).alias("text"),
    )
    return texts.cleaned(d)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", texts.page_title(F.col("html")).alias("title"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.chunks(documents(spark, sf_dir))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.col("html"), F.lit("<table><tr><td rowspan=2>a<td colspan=2>b"), F.lit("<tr><td>c<td>"), F.col("page_id").cast("string"), F.lit("</table>")).alias("html"))
    return texts.html_tables(p).select("page_id", "table_index", F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), ";").alias("cells"))


def representative_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return texts.representative_chunks(d.select("source", "doc_id", F.col("text").alias("chunk")), "source", "chunk", "doc_id").select("source", "doc_id")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.char_length(scalars.snippet(F.col("text"), 60)).alias("n"), scalars.stable_id(F.col("source"), F.col("lang")).alias("id"))


def intent_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("公司"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("在20"), F.lpad((F.col("o_orderkey") % 20 + 10).cast("string"), 2, "0"), F.lit("-20"), F.lpad((F.col("o_orderkey") % 7 + 12).cast("string"), 2, "0"), F.lit("年半年度营收前"), (F.col("o_orderkey") % 9 + 1).cast("string")).alias("q"))
    return q.select("o_orderkey", F.array_join(F.transform(scalars.asked_years(F.col("q"), 2026), lambda y: y.cast("string")), ",").alias("years"), F.array_join(scalars.asked_periods(F.col("q")), ",").alias("periods"), scalars.asked_limit(F.col("q"), F.lit(True)).alias("n"))


def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_sessions(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        bm25_topk, doc_quota, filtered_else_all, rerank_identity, reranked_by_length, interleave, keyword_overlap, dense_topk, tokenize_df, retrieval_metrics, recall_ceiling, bootstrap_ci, status_crosstab,
        win_rates, executability_status, slot_diff, golden_merge, review_shortlist, label_judge_counts, effective_quota, text_sections, pipe_tables, text_clean_lines, page_titles, chunk_documents, html_tables,
        representative_chunks, snippets, intent_years, session_fold,
    )
    return {f.__name__: f for f in own} | {"fuse_rrf": fuse("rrf"), "fuse_weighted": fuse("weighted")}


_BM25 = """toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
dls AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dls),
p AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY ALL), qs AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
qf AS (SELECT qid, token, count(*) AS qf FROM qs GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
scored AS (SELECT qid, doc_id, round(sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qf JOIN p USING (token) JOIN df USING (token) JOIN dls USING (doc_id), st GROUP BY qid, doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 10)"""
_SECOND = """, se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank
FROM (SELECT qid, doc_id, count(*)::DOUBLE AS score FROM (SELECT DISTINCT doc_id, token FROM toks) JOIN (SELECT DISTINCT qid, token FROM qs) USING (token) WHERE length(token) > 1 GROUP BY ALL)) WHERE rank <= 6)"""
_GOLD = ", gold AS (SELECT DISTINCT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _fused(share: str) -> str:
    return f"""WITH {_BM25}{_SECOND}, u AS (SELECT qid, doc_id, 'bm25' AS c, score, rank FROM bm UNION ALL SELECT qid, doc_id, 'vector', score, rank FROM se),
f AS (SELECT qid, doc_id, round(sum({share}), 9) AS score, round(max(score) FILTER (c = 'bm25'), 6) AS bm25, round(max(score) FILTER (c = 'vector'), 6) AS vector FROM u GROUP BY qid, doc_id)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_topk": f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bm",
        "rerank_identity": f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bm WHERE rank <= 5",
        "reranked_by_length": f"WITH {_BM25} SELECT qid, doc_id, r::INT AS rank, n_chars::DOUBLE AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, rank) AS r FROM bm JOIN documents USING (doc_id)) WHERE r <= 5",
        "fuse_rrf": _fused("1.0::DOUBLE / (60 + rank)"),
        "fuse_weighted": _fused("CASE c WHEN 'bm25' THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END * score"),
        "doc_quota": f"WITH {_BM25}, q AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS n FROM bm JOIN documents USING (doc_id)) SELECT qid, doc_id, source, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM q WHERE n <= 2",
        "filtered_else_all": f"WITH {_BM25}, q AS (SELECT *, max((lang = 'de')::INT) OVER (PARTITION BY qid) AS fits FROM bm JOIN documents USING (doc_id)) SELECT qid, doc_id, lang, rank FROM q WHERE fits = 0 OR lang = 'de'",
        "interleave": f"WITH {_BM25}{_SECOND}, t AS (SELECT qid, doc_id, min(rank * 2 + c) AS turn FROM (SELECT *, 0 AS c FROM bm UNION ALL SELECT *, 1 FROM se) GROUP BY qid, doc_id) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY turn, doc_id)::INT AS rank FROM t",
        "keyword_overlap": """WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), b AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
s AS (SELECT qid, doc_id, count(*)::DOUBLE AS score FROM a JOIN b USING (token) WHERE length(token) > 1 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 5""",
        "dense_topk": """WITH s AS (SELECT q.vec_id AS qid, v.vec_id, greatest(round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), 0) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 8""",
        "tokenize_df": "SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL) GROUP BY token",
        "retrieval_metrics": f"""WITH {_BM25}{_GOLD}, h AS (SELECT qid, count(*) AS n, count(rank) AS hit, min(rank) AS best FROM gold LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) USING (qid, doc_id) GROUP BY qid)
SELECT count(*) AS questions, round(avg((hit > 0)::INT::DOUBLE), 6) AS hit_rate, round(avg(hit / n), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM h""",
        "recall_ceiling": f"WITH {_BM25}{_GOLD} SELECT round(avg(least(2, n) / n), 6) AS ceiling FROM (SELECT qid, count(*) AS n FROM gold GROUP BY qid)",
        "bootstrap_ci": """WITH c AS (SELECT list_sum(list_transform(range(k + 1), lambda j: exp(-1::DOUBLE) / factorial(j::INT)::DOUBLE)) AS p FROM range(13) t(k)),
d AS (SELECT r.round, quality::DOUBLE AS v, ('0x' || substr(md5('20260807:' || r.round || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM labels, range(2000) r(round) WHERE quality IS NOT NULL),
e AS (SELECT round, v, list_sum(list_transform((SELECT list(p) FROM c), lambda p: (u >= p)::INT)) AS n FROM d),
m AS (SELECT round, sum(v * n) / nullif(sum(n), 0) AS m FROM e GROUP BY round), s AS (SELECT m, row_number() OVER (ORDER BY m, round) AS p FROM m WHERE m IS NOT NULL)
SELECT round(max(m) FILTER (p = 50), 6) AS low, round(max(m) FILTER (p = 1950), 6) AS high FROM s""",
        "status_crosstab": "SELECT event_type, user_id % 3 AS kind, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)",
        "win_rates": """WITH v AS (SELECT event_type, CASE WHEN user_id % 2 = 0 AND event_id % 4 = 0 THEN 'B' WHEN user_id % 2 = 0 AND event_id % 4 = 1 THEN 'A' WHEN event_id % 4 = 0 THEN 'A' WHEN event_id % 4 = 1 THEN 'B' ELSE 'T' END AS w FROM events)
SELECT event_type, count(*) AS total, count(*) FILTER (w = 'A') AS wins, count(*) FILTER (w = 'B') AS losses, count(*) FILTER (w = 'T') AS ties, round(count(*) FILTER (w = 'A') / count(*), 6) AS win_rate FROM v GROUP BY event_type""",
        "executability_status": "SELECT CASE WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'clarification' WHEN event_id % 3 = 0 THEN 'sql_built' WHEN user_id % 4 > 0 THEN 'ok_nonempty' ELSE 'ok_empty' END AS status, count(*) AS n FROM events GROUP BY 1",
        "slot_diff": "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'metrics,years' WHEN doc_id % 4 = 0 THEN 'years' ELSE '' END AS differs FROM documents",
        "golden_merge": "SELECT doc_id AS qid, CASE WHEN quality = 0 THEN quality || ',' || toxic ELSE quality::VARCHAR END AS relevant FROM labels WHERE toxic <> 1",
        "review_shortlist": f"""WITH {_BM25}{_GOLD}, m AS (SELECT bm.*, gold.qid IS NOT NULL AS c FROM bm LEFT JOIN gold USING (qid, doc_id)), n AS (SELECT *, row_number() OVER (PARTITION BY qid, c ORDER BY rank) AS k FROM m)
SELECT qid, doc_id, CASE WHEN c THEN 'confirmed' ELSE 'candidate' END AS part FROM n WHERE c OR k <= 3 UNION ALL SELECT qid, doc_id, 'outside' FROM gold ANTI JOIN bm USING (qid, doc_id)""",
        "label_judge_counts": f"""WITH {_BM25}{_GOLD}, j AS (SELECT qid, doc_id, 1 AS j FROM bm WHERE rank <= 3), c AS (SELECT qid, doc_id, 1 AS c FROM gold), pool AS (SELECT qid, doc_id, 1 AS inside FROM bm)
SELECT qid, count(*) FILTER (j = 1 AND c = 1) AS hits, count(*) FILTER (c IS NULL) AS extra, count(*) FILTER (j IS NULL) AS missed, count(*) FILTER (c = 1 AND inside IS NULL) AS not_in_pool FROM j FULL JOIN c USING (qid, doc_id) LEFT JOIN pool USING (qid, doc_id) GROUP BY qid""",
        "effective_quota": "SELECT n_nationkey, coalesce(least(nullif(n_nationkey % 5, 0), nullif(n_regionkey, 0)), nullif(n_nationkey % 5, 0), nullif(n_regionkey, 0), 0) AS quota FROM nation",
        "snippets": r"""WITH t AS (SELECT doc_id, source, lang, trim(regexp_replace(coalesce(text, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 60 THEN length(rtrim(s[1:59])) + 1 ELSE length(s) END::INT AS n, 'doc-' || md5(source || '|' || lang)[1:16] AS id FROM t""",
        "text_sections": r"""WITH t AS (SELECT doc_id, source, lang, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[\s\x{0b}\x{85}\x{a0}]+|[\s\x{0b}\x{85}\x{a0}]+$', '', 'g') AS s FROM documents)
SELECT doc_id, n::INT AS section_no, CASE n WHEN 1 THEN source ELSE lang END AS section_title, md5(s) AS tag FROM t, range(1, 3) r(n) WHERE s <> ''""",
        "pipe_tables": "SELECT doc_id, 1 AS table_index, source || '~' || lang || ';' || n_chars || '~x' AS cells FROM documents UNION ALL SELECT doc_id, 2, 'z' FROM documents",
        "text_clean_lines": "SELECT doc_id, '# 利润表' || chr(10) || '| ' || source || ' |' || chr(10) || '净利润 1' || chr(10) || '| 项目 | 1 |' AS text FROM documents",
        "page_titles": "SELECT page_id, trim(regexp_replace(regexp_replace(nullif(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages",
        "html_tables": "SELECT page_id, 1 AS table_index, 'a~b~;a~c~' || page_id AS cells FROM pages",
        "representative_chunks": """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY regexp_matches(text, '免责声明|评级说明|法律声明|风险提示|分析师声明'), coalesce(length(regexp_replace(text, '[^|]', '', 'g')) / nullif(length(text), 0), 0) > 0.05::DOUBLE, doc_id) AS n FROM documents) WHERE n <= 3""",
        "intent_years": """WITH q AS (SELECT o_orderkey, 2010 + o_orderkey % 20 AS a, 2012 + o_orderkey % 7 AS b FROM orders)
SELECT o_orderkey, array_to_string(range(least(a, b), greatest(a, b) + 1), ',') AS years, 'HY' AS periods, (o_orderkey % 9 + 1)::INT AS n FROM q""",
    }

"""The operators' queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import decontam, jaccard_join, langid, lattice, lexical, lm, media, packing, pii, secrets, sharding, spelling, url_rules
from sigloom.llm.util import table

#: The url rules, as (host/path, verdict).
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
PII_KEY = "sigloom-pseudonyms-1"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", "n_pii", *(f"n_{k}" for k in pii.KINDS))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict_language(docs, learn=~langid.held_out(F.col("doc_id")))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(table(spark, sf_dir, "documents"), learn=~lm.held_out(F.col("doc_id")))
    return out.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_media(table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filters, op2_sharding, op3_ngram_jaccard_join, op4_packing, op5_pii, op6_language_id, op7_lm_scoring, op8_decontamination, op9_secret_scans, op10_media_columns)
    return {f.__name__: f for f in (*every, op11_lexical_search, op12_embedding_dedup, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    host = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
    rules = ", ".join(f"('{r}', '{url_rules.rule_parts(r)[0]}', '{url_rules.rule_parts(r)[1]}', '{v}')" for r, v in URL_RULES)
    op1 = f"""
        WITH p AS (SELECT row_number() OVER () AS k, page_id, {host} AS host, {path} AS path FROM pages),
        r(rule, rhost, rpath, verdict) AS (VALUES {rules}),
        f AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
              FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
        SELECT page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (k)"""
    words = "string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    op11 = f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter({words}, lambda x: x <> '') AS terms FROM documents),
        i AS (SELECT row_number() OVER () AS item, item_id, list_filter({words}, lambda x: x <> '') AS terms FROM benchmark),
        s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
        p AS (SELECT k, t, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS t FROM d) GROUP BY k, t),
        w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
        q AS (SELECT DISTINCT item, unnest(terms) AS t FROM i),
        m AS (SELECT k, doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
        r AS (SELECT item, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (k) GROUP BY item, k, doc_id)
        SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
              FROM r JOIN i USING (item) WHERE score > 0) WHERE rank <= {lexical.TOP}"""
    op12 = f"""
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {lattice.LEAST_COSINE}),
        r(a, b) AS (SELECT k, k FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT r.a AS k, min(v.vec_id) AS component_id FROM r JOIN v ON r.b = v.k GROUP BY r.a),
        n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (k) LEFT JOIN n USING (k)"""
    return {"op1_url_filters": op1, "op11_lexical_search": op11, "op12_embedding_dedup": op12}

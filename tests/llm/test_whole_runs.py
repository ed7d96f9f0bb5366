"""op7 and the pipeline as registered, and operators over empty tables and tables whose columns have helpers' names."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from sigloom.llm import langid, pii, queries, url_rules
from tests.llm.test_queries import ITEM, corpus, sf, texts  # noqa: F401 (fixtures)


def test_scores(spark, sf, texts):  # noqa: F811
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for _, t in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts]
    counts = Counter(w for own, h in zip(tokens, held) if not h for w in own)
    ends = sum(not h for h in held)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    p = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    want = Counter((i, h, len(own) + 1, sum(w in counts for w in own) + 1, total, round(sum(p(counts[w]) for w in own) + p(ends), 5)) for (i, _), own, h in zip(texts, tokens, held))
    got = queries.queries()["op7_lm_scoring"](spark, sf).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    # The model of the corpus tells its own texts from the same words in another order of letters.
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


def test_the_whole_pipeline_is_its_stages_one_after_another(spark, sf, tmp_path):  # noqa: F811
    folder, more = f"file://{tmp_path}", f"{corpus()[1][1]} {corpus()[3][1]} password=hunter22xyz9 {corpus()[5][1]}"
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    own.union(spark.createDataFrame([(200, more, "en", "s", len(more))], own.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    sf, docs = folder, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            assert docs.count() <= before.count() and (k != 3 or docs.count() == before.count())
        if k == 3:
            left = docs
    kept = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert not any(ITEM in (t or "") for _, t in kept)
    assert {i for i, _ in kept} > {200} and [t for i, t in kept if i == 200] == [more.replace("password=hunter22xyz9", corpus_pipeline.MASK)]
    got = corpus_pipeline.run(spark, sf).collect()
    shown = lambda rows: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert shown(got) == shown(docs.collect()) and {r["doc_id"] for r in got} == {i for i, _ in kept}
    assert sum(r["length"] for r in got) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in got}.values())


def test_clashing_columns_and_empty_tables(spark):
    rules = queries.URL_RULES
    pages = spark.createDataFrame([(1, "x://sub.net/fr/", 7, "h", "r")], "page_id long, url string, rule_found long, token string, rule_no string")
    assert [(r["host"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()] == [("sub.net", "block")]
    assert url_rules.judge_urls(pages.limit(0), rules).isEmpty() and url_rules.judge_urls(pages.limit(0), rules).columns[:2] == ["page_id", "url"]
    docs = spark.createDataFrame([(1, "mail a.b@c.de 123-45-6789", "en", 3, "x", 1.5)], "doc_id long, text string, lang string, pii_found int, has_letter string, n_chars double")
    got = pii.pseudonymise(docs, queries.PII_KEY).collect()[0]
    assert got["pii_found"] == 3 and got["n_pii"] == 2 and "123-45-6789" not in got["text"]
    assert pii.pseudonymise(docs.limit(0), queries.PII_KEY).isEmpty()
    assert langid.predict_language(docs.limit(0)).isEmpty()
    many = spark.createDataFrame([(i, x, lang, 1) for i in range(30) for x, lang in (("der und die nicht mit sich", "de"), ("the and of with not it", "en"))], "doc_id long, text string, lang string, has_letter int")
    out = langid.predict_language(many, learn=F.lit(True)).select("has_letter", "lang", "lang_pred").collect()
    assert all(r["has_letter"] == 1 for r in out) and sum(r["lang"] == r["lang_pred"] for r in out) > 50

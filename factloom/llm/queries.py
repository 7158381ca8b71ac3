"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import attention, bpe, collocations, filteraudit, langid, licenses, neardup, ngrams, oracles, packing, quality, simhash, urlfilter, warc
from factloom.llm.common import table
from factloom.llm.wordbpe import public_vocabulary


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("score", 6).alias("score"))


def op4_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def captures(pages: DataFrame) -> DataFrame:
    """Captures made of pages: a third of them of one URL, others of addresses that pages share, in mixed order of time.

    By the page's number a capture is a full response with one, both or none of the validators, a failed response, or
    one of five kinds of revisits; three versions of a body alternate.
    """
    n = F.col("page_id")
    key = F.when(n % 3 == 0, F.lit("hot.example/")).otherwise(F.regexp_replace(F.expr(urlfilter.node_sql("url")), "[0-9]+", ""))
    kind, version = (n * 7919) % 10, F.floor(n / 7) % 3
    tag, changed, digest = F.concat(F.lit("v"), version.cast("string")), F.concat(F.lit("day "), version.cast("string")), F.md5(version.cast("string"))
    response, date = kind < 5, (n * 104729) % 1000003
    etag = F.when(kind.isin(1, 2), tag).when(kind.isin(5, 9), F.concat(F.lit("W/"), tag))
    modified = F.when(kind.isin(0, 2, 6), changed)
    named = F.create_map(
        F.when(response, "ETag").otherwise("etag"), etag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.when(response, "text/html").otherwise("text/plain"),
        F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.when(response, 60).otherwise(n % 100).cast("string")), F.lit("Date"), date.cast("string"),
    )
    return pages.select(
        n.alias("record_id"), F.when(F.col("url").contains("://"), key).alias("url_key"), date.alias("date"), F.when(response, "response").otherwise("revisit").alias("kind"),
        F.when(kind == 4, 404).when(response, 200).otherwise(304).alias("status"), F.map_filter(named, lambda _, v: v.isNotNull()).alias("headers"),
        F.when(kind.isin(7, 9) | ((kind == 3) & (n % 2 == 0)), digest).alias("digest"),
    )


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the captures of all pages: the response that answers it, the outcome, the merged headers."""
    found = warc.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "url_key", "date", "resolved_id", "outcome", shown.alias("headers"))


def op6_ordered_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def op8_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))


def op9_marginal_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), public_vocabulary("piece_bpe_32k.model")
    model = langid.train(docs, vocabulary)
    return langid.identify(docs.select("doc_id", "text"), model, vocabulary).drop("text")


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention.train(docs, table(spark, sf_dir, "labels"))
    scored = attention.score(docs, model)
    return scored.select("doc_id", attention.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "top_passage")


def op12_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_wide_packed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op12_son_collocations": oracles.collocations(), "op13_wide_packed_counters": oracles.filter_audit(), "op5_revisit_resolution": oracles.revisits(), "op3_stupid_backoff": oracles.stupid_backoff(), "op2_redirect_equivalence": oracles.url_filter(URL_RULES), "op4_risk_controlled_rules": oracles.quality_rules()}

"""Registered queries of the training-data operators (op1 .. op13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, kd_sharding, language_id, oracles, pseudo_likelihood, quality_rules, secret_scan, sentencepiece_lattice,
               shared_search, simhash, token_alignment, token_counts, url_filter, warc_store)
from .common import table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dicts = language_id.dictionaries(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, dicts)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, texts = pseudo_likelihood.fit(table(spark, sf_dir, "documents"))
    return pseudo_likelihood.score(texts, model)


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.read(spark, warc_store.write(table(spark, sf_dir, "pages")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(named(base), 256).alias("base_sha256"),
                        named(F.col("spans")).alias("spans"), number("random"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_url_filters, op3_sentencepiece, op4_simhash_near_dedup,
                            op5_benchmark_decontamination, op6_lm_scoring, op7_kd_sharding, op8_warc,
                            op9_quality_rules, op10_token_counts, op11_secret_scans, op12_ranked_search, op13_token_alignment)}
# the other queries train a model, hash by XXH64 or follow a tokenizer file; the tests hold them against brute force
SQL: dict[str, str] = {
    "op2_url_filters": oracles.url_filters(URL_RULES),
    "op5_benchmark_decontamination": oracles.decontamination(decontamination.WINDOW, decontamination.MIN_SHARE),
    "op8_warc": oracles.warc(),
    "op12_ranked_search": oracles.ranked_search(shared_search.TOP),
}

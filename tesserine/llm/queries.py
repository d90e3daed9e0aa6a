"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import contamination, html, language, neardup, oracles, packing, prefix_trie, quality, runs, sharding, substring, token_counts, urls, warc
from tesserine.llm.tables import need, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """The default tokenizer; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    test = language.held_out(F.col("doc_id"))
    return language.identify(docs.withColumn("held_out", test), language.learn(docs.where(~test)), keep=["doc_id", "held_out"])


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: Of the contract: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


ORACLES |= {"op4_quality": oracles.QUALITY, "op5_warc": oracles.WARC, "op7_urls": oracles.url_filter(RULES)}


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(table(spark, sf_dir, "documents"))


@query
def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES |= {"op3_near_duplicates": oracles.NEAR_DUPLICATES, "op6_contamination": oracles.contaminated("documents"), "op9_substrings": oracles.SUBSTRINGS}


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.numbered(table(spark, sf_dir, "conversations")))))


#: Of the contract.
SHARDS = 8


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


ORACLES |= {"op11_prefix_trie": oracles.TRIE, "op12_sharding": oracles.shards(SHARDS)}

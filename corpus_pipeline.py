"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import contamination, language, neardup, packing, substring
from tesserine.llm.queries import vocabulary
from tesserine.llm.tables import kept, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Dictionaries are learned from the labelled ones that are not held out."""
    pools = language.learn(docs.where(~language.held_out(docs["doc_id"])))
    return language.identify(docs, pools).where("NOT rejected").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    gone = neardup.near_duplicates(docs, shingle=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(kept(gone, "duplicates"), "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that appear earlier are cut out; n_chars follows the text."""
    return substring.remove_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language", identified), ("near_duplicates", distinct), ("substrings", without_repeats), ("contamination", decontaminated), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Corpus pipeline over ``documents``: keep what has a language, drop exact and near copies, mix sources, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.  ``run`` writes each stage's rows to the
shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import exact_dedup, langid, mixing, packing, simhash
from tidewheel.llm.store import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or whose language the network can't tell although there are letters enough; null and empty texts go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space as one space, null as empty) the smallest doc_id stays; rows without doc_id stay."""
    return exact_dedup.drop_exact_duplicates(docs, Workspace(spark, "pipeline-exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays; rows without doc_id stay."""
    return simhash.drop_near_duplicates(docs, Workspace(spark, "pipeline-near"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whole, each as often as its source's target asks; null is a source, sources without words don't come."""
    return mixing.sample_mix(docs, Workspace(spark, "pipeline-mix"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens; a null or empty text is its end id alone.  An empty table gives an empty result in every stage."""
    return packing.pack(docs, Workspace(spark, "pipeline-pack"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]

#: A network, a fingerprint search and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}

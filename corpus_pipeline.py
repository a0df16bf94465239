"""A training-data pipeline over ``documents``: language, quality, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import langid, mixing, near_dedup, packing, quality
from treeloom.llm.common import stored

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; texts without letters, or of doubtful language, go."""
    return langid.keep_known(docs, langid.fit_ppm(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score above the quality threshold learned from ``labels``."""
    features = stored(quality.with_features(docs.select("doc_id", "text")), "quality")
    model = quality.learn(features, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, always whole."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # the mix adds columns of its own
    key, text, source = (names[c] for c in ("doc_id", "text", "source"))
    plan = mixing.mix(docs.toDF(*names.values()), F.array(source), key, text)
    return mixing.take(plan, list(names.values())).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("quality", good_quality), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: No SQL expresses byte context trees, learned scores or packing patterns; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: rules, dedup, mixing and packing, each over what the stage before kept.

Every stage takes documents with any further columns and gives the same columns,
but the last, which gives packed pieces. Null texts count as empty; the rules
reject them. Rows without an id are never held to be copies of others by near
dedup; rows that repeat an id are documents of their own. Texts are read whole,
however long: one is a row of one task. An empty table goes through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import exact, mixing, near, packing, quality
from runlens.llm.shared import table, written
from runlens.llm.tokens import WORD_BPE

#: Domains' shares are their natural ones to this power; no document is dropped for it.
TEMPER, SEED = 0.8, 2
ROOM, END_ID = 4096, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.where("kept").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the smallest id stays."""
    return exact.unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word similarity of 0.8 or more, the one with the smallest id stays."""
    return near.unique(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small domains repeat until the domains' shares are tempered; all stay."""
    mixer = mixing.fit(docs, table(spark, sf_dir, "labels"), TEMPER, least=1.0)
    return mixing.mixed(docs, mixer, SEED)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces in sequences."""
    return packing.packed(docs, WORD_BPE, ROOM, END_ID)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources),
          ("best_fit_packing", best_fit_packing)]

#: The stages hold fitted trees, a fitted mixture and a packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

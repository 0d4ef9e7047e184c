"""From raw documents to shards of a training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns is written as Parquet and is the next one's
``docs``. All but the last return the columns of ``docs``, whatever others there are beside those of ``documents``; the last adds
each row's shard. An empty table gives an empty one at every stage. No stage cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, mixing, near_dedup, sharding, toxicity
from quarry.llm.common import cut, discard, scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts have no sentence and stay, rows that repeat are scored alike, ids
    don't matter. The model is fitted on a bounded sample of labelled documents (toxicity.SAMPLE)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.clean_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id. Texts without words and rows without an id are
    in no class and stay; of rows that share an id one stays."""
    return near_dedup.deduplicated(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; items without words have none; rows that
    repeat share their fate."""
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or twice. A null source is a source of its own; texts
    without words carry no weight and are passed once; rows that repeat hold places of their own."""
    return mixing.mixed_rows(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard. A null text has no bytes; rows that repeat may go to different shards, so that any number fits."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL can't express the learned stage; tests/llm hold the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        keep: list[DataFrame] = []
        with scope(spark, keep):  # what a stage cut for itself goes once its result is written
            kept = cut(stage(spark, docs, sf_dir), name)
            keep.append(kept)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

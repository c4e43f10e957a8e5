"""The corpus pipeline: toxicity, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. The first four
return the columns of documents; the last returns the packed pieces. run() writes each stage's rows
as Parquet in the shared folder that the session names in spark.checkpoint.dir and reads them again; a
stage's folder is deleted once the next one is written, so that only the last stays, which the result reads.

Defined results: null and empty texts are scored as texts without words and are no copies of anything; rows
without a doc_id are never dropped as copies; of an id that repeats with several texts, each text is judged on
its own, and those stay that are the first of their group, once each; a group of copies is kept by its least
doc_id; scores at the border of 0.5 are toxic and of good quality; other columns are handed on; empty tables
pass all stages and give no pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import near_dedup, packing, pii, quality, toxicity
from gaugeline.llm.common import table
from gaugeline.shared import shared_folder
from gaugeline.sources import marks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_duplicates),
    ("pii", sanitise),
    ("packing", pack),
]

#: No stage's model can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    at, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}_{name}")
        docs = spark.read.parquet(f"{at}/{k}_{name}")
        if k:
            marks.drop(spark, f"{at}/{k - 1}_{STAGES[k - 1][0]}")
    return docs

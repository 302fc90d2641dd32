"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; its result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.bpe import encoding_stage
from lexloom.llm.decontam import decontamination_stage
from lexloom.llm.linededup import dedup_stage
from lexloom.llm.nearstage import near_dedup_stage
from lexloom.llm.toxicity import toxicity_stage
from lexloom.session import delete, stage, staged_tables

STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Learned weights, tries and tokens can't be put in SQL; tests/llm checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of ``documents``. What a stage has written
    for itself goes once its result is written, and so does its input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with staged_tables() as made:
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        delete(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

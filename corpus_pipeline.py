"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what
a stage returns to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import decontaminate, jaccard, packing, quality, suffixes
from gridspark.llm.common import small_batches, table, written
from gridspark.session import ship


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(small_batches(ship(spark)), docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _shipped(quality.stage)),
    ("n-gram Jaccard join", _shipped(jaccard.stage)),
    ("suffix-array dedup", _shipped(suffixes.stage)),
    ("benchmark decontamination", _shipped(decontaminate.stage)),
    ("best-fit packing", _shipped(packing.stage)),
]

#: No stage but the exact ones could be told in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

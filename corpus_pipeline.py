"""A training-data pipeline of five stages over the table `documents`."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import stages
from lodestrata.llm.common import drop_folder, read, work_folder

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_dedup", stages.drop_near_duplicates),
    ("substring_dedup", stages.cut_repeats),
    ("decontamination", stages.drop_contaminated),
    ("sentencepiece", stages.encode),
]

#: SQL can't express stages 1, 2 (learned weights, fingerprints) or 5; tests/llm compares each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written as Parquet in the shared folder and read again, and dropped once its successor is written."""
    docs, folder, last = read(spark, sf_dir, "documents"), work_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := posixpath.join(folder, name))
        if last:
            drop_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs

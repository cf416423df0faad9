"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage reads what the one before it kept, as Parquet. run() applies all of them to documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from proofbase.llm import decontaminate, jaccard, mixing, quality, sharding
from proofbase.llm.common import shared_dir

STAGES = [
    ("quality rules", quality.pipeline_stage),
    ("n-gram jaccard join", jaccard.pipeline_stage),
    ("benchmark decontamination", decontaminate.pipeline_stage),
    ("mixing to target weights", mixing.pipeline_stage),
    ("sharding", sharding.pipeline_stage),
]

#: The mixing stage's classifier is not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

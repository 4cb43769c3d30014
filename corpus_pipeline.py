"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.bpe import bpe_stage
from vellum.llm.lines import line_dedup_stage
from vellum.llm.minhash import near_dedup_stage
from vellum.llm.mixing import mixing_stage
from vellum.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The stages learn models and merge by rank; SQL cannot express them. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

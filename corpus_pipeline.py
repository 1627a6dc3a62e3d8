"""Corpus pipeline: toxicity filter, near-dedup, benchmark decontamination, mixing, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents; the last returns a row for each document
that it wrote, from the token files: doc_id, start, n_tokens, ids_crc32. The mixing stage
may take a document more than once, so the last stage may hold a doc_id twice.

ORACLE_SQL is None: the learned filters and the sampled similarity aren't SQL; tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from switchback.llm import decontam, mixing, near_dedup, token_output, toxicity
from switchback.llm.store import Workspace

STAGES = [
    ("toxicity", toxicity.pipeline_stage),
    ("near_dedup", near_dedup.pipeline_stage),
    ("decontamination", decontam.pipeline_stage),
    ("mixing", mixing.pipeline_stage),
    ("token_output", token_output.pipeline_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of `sf_dir`."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, decontaminate, quality, simhash, suffix
from lodestar.llm._spark import delete
from lodestar.session import shared_dir

STAGES = [
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("suffix-array dedup", suffix.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("byte-level BPE encoding and decoding", bpe.stage),
]

#: The stages learn weights, cluster and tokenize; SQL can't express that, so a brute-force version checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again as the next one's input, and deleted when that is written.

    What each stage does with null, empty and repeated texts is said there; empty documents give no rows. Columns beside
    those of ``documents`` pass through all stages but the last.
    """
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            delete(spark, f"{place}/{k - 1}")
    return docs

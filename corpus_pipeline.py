"""From raw documents to packed sequences, in five stages that each read what the one before has written.

Near copies are grouped by SimHash's operator at a similarity of 0.8 (see there how). Mixing may leave a document out or
repeat it, as the targets say. ORACLE_SQL is None: trained classifiers, XXH64 votes and a BPE tokenizer can't be expressed
in SQL. The tests hold the stages against brute-force versions.

Each stage handles null, empty and very long texts, nulls in any column, repeated rows, empty tables and extra columns as its
operator's docstring says; rows without a text or a letter go in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomvec.llm import language_id, mixing, packing, simhash, toxicity
from loomvec.llm._common import Scratch, delete_folder, shared_folder

STAGES = [
    ("language ID", language_id.stage),
    ("toxicity", toxicity.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. Every stage's result is a Parquet table in the shared folder, which goes, with all
    that was checkpointed to make it, as soon as the next one is written; the last one's stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

"""Content-addressed deduplication as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.functions.text import point_id, text_hash


def addressed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``source_text``, ``source_hash`` and ``point_id``; rows without text go."""
    named = df.where(F.col(text).isNotNull()).withColumn("source_text", F.col(text).cast("string"))
    return named.withColumn("source_hash", text_hash("source_text")).withColumn("point_id", point_id("source_hash"))


def unseen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose ``source_hash`` isn't among the known ones; Catalyst broadcasts the known side when its size allows."""
    return rows.join(known.select("source_hash"), "source_hash", "left_anti")


def seen(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known.select("source_hash"), "source_hash", "left_semi")


def one_per_text(rows: DataFrame) -> DataFrame:
    """One row for each text: the copies combine before they are shuffled."""
    return rows.select("point_id", "source_hash", "source_text").dropDuplicates(["source_hash"])

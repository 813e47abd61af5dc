"""Exact token counts from a length histogram.

Documents are encoded once and aggregated by encoded length. The histogram has one row for each distinct
length, at most about the square root of twice the corpus's tokens, and its suffix sums answer totals,
quantiles and truncated totals for every context limit without another pass over documents.

Defined results: null and empty texts have length 0 and count as documents; an empty table gives no rows.
Repeated rows count once each, and very long texts with all their tokens; extra columns are ignored, and ties are documents of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import blocks, small_batches, spread, trimmed
from loomvec.llm.encoding import default_path, worker_encoder


def lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for b in blocks(batch, "text"):
                n = [len(i) // 4 for i in encoder.encode([t or "" for t in b.column("text").to_pylist()])]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64())})

    return small_batches(spread(docs.select("doc_id", text))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) by encoded length."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits_table(hist: DataFrame) -> DataFrame:
    """Answers for every context limit that is a length of the histogram.

    ``docs_over`` and ``tokens_over`` are the documents longer than the limit and their tokens (suffix sums),
    ``truncated_total`` the tokens left if every document is cut at the limit, ``share_within`` the share of
    documents that fit: the limit is the quantile of that share.
    """
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return hist.select(
        F.col("n_tokens").alias("context_limit"), "n_docs",
        F.coalesce(F.sum("n_docs").over(down), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(tokens).over(down), F.lit(0)).alias("tokens_over"),
        (F.sum(tokens).over(up) + F.col("n_tokens") * F.coalesce(F.sum("n_docs").over(down), F.lit(0))).alias("truncated_total"),
        F.sum(tokens).over(whole).alias("total_tokens"),
        F.try_divide(F.sum("n_docs").over(up), F.sum("n_docs").over(whole)).alias("share_within"),
    )


def with_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``hist`` with a row for each of ``limits``, of no documents where none has that length."""
    asked = hist.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*(F.lit(n).cast("long") for n in sorted(set(limits))))).alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"))
    return hist.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def answers(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limits_table`` for any limits, whether a document has that length or not."""
    return limits_table(with_limits(hist, limits)).where(F.col("context_limit").isin(sorted(set(limits))))


def quantile(hist: DataFrame, q: float) -> int | None:
    """Smallest length that at least a share ``q`` of the documents doesn't exceed."""
    row = limits_table(hist).where(F.col("share_within") >= q - 1e-12).agg(F.min("context_limit")).first()
    return row[0]


#: Context limits that the query answers besides all lengths that occur: the powers of two up to 2^20.
ASKED = [1 << k for k in range(21)]


def query(spark, sf_dir: str) -> DataFrame:
    """What the histogram answers for a context limit of every length that occurs, and for those ASKED whether they occur or not; no documents, no rows."""
    hist = histogram(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return limits_table(with_limits(hist, ASKED)).where("share_within is not null")

"""The change-feed refresh as a stream: Spark's checkpoint keeps the offsets, the ledger keeps the audit trail and each text's holders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomvec.plans.ledger import Ledger
from loomvec.plans.watch import DEFAULT_MODEL, watch


def stream_refresh(changes: DataFrame, text_col: str, sink: str, checkpoint: str, *, model: str = DEFAULT_MODEL, source_table: str = "stream", key_col: str | None = None, shadow_mode: bool = False, ledger: Ledger | None = None, live_table: Callable[[], DataFrame] | None = None, provider_options: dict | None = None) -> StreamingQuery:
    """Apply a streaming feed, from its first version on, batch by batch until what is there has been read; a repeated batch changes nothing twice.

    A batch doesn't tell which texts untouched rows have: the ledger counts them, or ``live_table()`` reads the source as it stands. The ledger counts by batches of this
    stream, which its checkpoint identifies: on another checkpoint it would count what is counted already, and so raises an error unless there is a live table.
    """
    if ledger is None and live_table is None:
        raise ValueError("a stream needs a ledger or a live table to know which texts are still in use")

    def apply(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        kept = batch.persist()
        try:
            watch(source_table, text_col, sink, model=model, since_version=0, shadow_mode=shadow_mode, ledger=ledger, key_col=key_col, feed=kept, live_table=live_table() if live_table else None, provider_options=provider_options, batch=(f"stream {stream}", number))
        finally:
            kept.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(changes: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running counts by change type and version of a streaming feed, into an in-memory table ``name``."""
    counts = changes.groupBy("_change_type", "_commit_version").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

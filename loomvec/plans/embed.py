"""Batch embedding: text column to vector collection, deduplicated within the batch and against earlier runs."""

from __future__ import annotations

import time
import uuid
import warnings
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.functions.text import parse_model
from loomvec.operators.dedup import addressed, one_per_text, unseen
from loomvec.plans.ledger import Ledger
from loomvec.plans.providers import DEFAULT_PRICE, PRICES, provider
from loomvec.plans.session import Scratch, get_spark
from loomvec.sources.sinks import Sink, open_sink, put, refresh


@dataclass
class EmbedRun:
    model: str
    sink: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: datetime = field(default_factory=lambda: datetime.now(UTC))
    n_rows_processed: int = 0
    n_rows_deduped: int = 0
    n_in_batch_dupes: int = 0
    n_null: int = 0
    cost_usd: float = 0.0
    duration_s: float = 0.0


def batch_metrics(df: DataFrame, text: str, known: DataFrame | None) -> DataFrame:
    """One row: n_rows, n_null, n_deduped (rows whose text is known) and n_in_batch_dupes (further rows of a new text)."""
    counts = df.agg(F.count(text).alias("n_rows"), F.count_if(F.col(text).isNull()).alias("n_null"))
    # copies are counted before anything is shuffled, so a text with very many copies is one row here
    by_hash = addressed(df, text).groupBy("source_hash").agg(F.count("*").alias("n"))
    if known is None:
        marked = by_hash.withColumn("known", F.lit(None).cast("int"))
    else:
        marked = by_hash.join(known.select("source_hash", F.lit(1).alias("known")), "source_hash", "left")
    dupes = marked.agg(F.coalesce(F.sum(F.when(F.col("known").isNotNull(), F.col("n"))), F.lit(0)).alias("n_deduped"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n") - 1)), F.lit(0)).alias("n_in_batch_dupes"))
    return counts.join(dupes)


def points(rows: DataFrame, run_id: str, at: datetime) -> DataFrame:
    return rows.select("point_id", "vector", "source_text", "source_hash", F.lit(run_id).alias("embed_run_id"), F.lit(at).cast("timestamp").alias("created_at"))


def record(ledger: Ledger | None, run: EmbedRun) -> None:
    if ledger:
        ledger.write_run(run_id=run.run_id, timestamp=run.timestamp, model=run.model, sink=run.sink, n_rows=run.n_rows_processed, n_deduped=run.n_rows_deduped, cost_usd=run.cost_usd, duration_s=run.duration_s)


def renew(new: DataFrame, gone: DataFrame | None, run: EmbedRun, target: Sink, scratch: Scratch, *, batch_size: int = 128, shadow_mode: bool = False, ledger: Ledger | None = None, prices: dict[str, float] = PRICES, provider_options: dict | None = None, merge: bool = True) -> None:
    """Vectors for ``new`` (point_id, source_hash, source_text; one row for each text) go into the sink, the points ``gone`` (point_id) out of it, and their provenance likewise.

    The provider's answers are written down before anything else reads them. Until the run's own row is written nothing of its provenance counts.
    """
    parsed = parse_model(run.model)
    made = scratch.keep(provider(parsed, shadow_mode)(new, parsed, batch_size, **(provider_options or {})))
    run.cost_usd += int(made.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0) * prices.get(parsed.name, DEFAULT_PRICE)
    if gone is None:
        put(target, points(made, run.run_id, run.timestamp), merge)
    else:
        refresh(target, points(made, run.run_id, run.timestamp), gone)
    if ledger:
        ledger.trace(made, made.select("point_id").limit(0) if gone is None else gone, run.run_id, run.timestamp, run.model, run.sink)


def embed(df: DataFrame | None, text_col: str, model: str, sink: str, *, source_table: str | None = None, dedup: bool = True, batch_size: int = 128, shadow_mode: bool = False, ledger: Ledger | None = None, prices: dict[str, float] = PRICES, provider_options: dict | None = None, slice_rows: int = 100_000, stable: bool = False) -> EmbedRun:
    """Embed ``text_col`` of ``df`` (or of ``source_table``) into ``sink``; see EmbedRun for what is reported.

    Everything that can be refused is refused before anything is spent. The provider runs once, over distinct new texts. More than ``slice_rows`` of them are
    written down first and embedded slice by slice, each of which is in the sink and the ledger before the next begins: if the provider fails, the slices before aren't paid for
    again by the next run with that ledger. ``stable`` says that ``df`` is written down already and has the same rows each time it is read: if it holds no text twice, as is counted
    by the texts' hashes, whole texts needn't be shuffled.
    """
    parsed, target = parse_model(model), open_sink(sink)
    provider(parsed, shadow_mode)
    run, began = EmbedRun(model, sink), time.monotonic()
    if df is None:
        if source_table is None:
            raise ValueError("either a DataFrame or a source table is needed")
        df = get_spark().table(source_table)
    if dedup and ledger is None:
        warnings.warn("without a ledger texts are known only within this batch: those of earlier runs are embedded, and paid for, again", stacklevel=2)
    source = df.select(text_col)
    known = ledger.known_hashes(model, sink) if dedup and ledger else None
    m = batch_metrics(source, text_col, known).first()
    run.n_rows_processed, run.n_null, run.n_rows_deduped, run.n_in_batch_dupes = m["n_rows"], m["n_null"], m["n_deduped"], m["n_in_batch_dupes"]
    if run.n_rows_processed > run.n_rows_deduped:
        distinct = stable and not run.n_in_batch_dupes
        new = addressed(source, text_col)
        new = new.select("point_id", "source_hash", "source_text") if distinct else one_per_text(new)
        if known is not None:
            new = unseen(new, known)
        how = {"batch_size": batch_size, "shadow_mode": shadow_mode, "ledger": ledger, "prices": prices, "provider_options": provider_options}
        slices = -(-(run.n_rows_processed - run.n_rows_deduped - run.n_in_batch_dupes) // slice_rows)
        with Scratch(df.sparkSession) as scratch:
            if slices > 1:
                new = scratch.keep(new.withColumn("slice", F.pmod(F.xxhash64("source_hash"), F.lit(slices)).cast("int")), "slice")
                for k in range(slices):
                    renew(new.where(F.col("slice") == k).drop("slice"), None, run, target, scratch, merge=False, **how)
                    run.duration_s = time.monotonic() - began
                    record(ledger, run)
            else:
                renew(new, None, run, target, scratch, **how)
    run.duration_s = time.monotonic() - began
    record(ledger, run)
    return run

"""Change-feed refresh: bring a collection up to date with the net change of its source since the last run."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.functions.text import parse_model, point_id, text_hash
from loomvec.operators.dedup import addressed, one_per_text
from loomvec.plans.embed import EmbedRun, record, renew
from loomvec.plans.ledger import VERSIONS, Counted, Ledger
from loomvec.plans.providers import provider
from loomvec.plans.session import Scratch, get_spark
from loomvec.sources.changefeed import WINDOW_COUNTS, changes_by_text, holders, read_feed, read_live, window
from loomvec.sources.sinks import open_sink

DEFAULT_MODEL = "openai/text-embedding-3-small"


@dataclass
class WatchRun:
    source_table: str
    sink: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: datetime = field(default_factory=lambda: datetime.now(UTC))
    since_version: int = 0
    to_version: int = 0
    n_inserted: int = 0
    n_updated: int = 0
    n_deleted: int = 0
    duration_s: float = 0.0


def watch(source_table: str, text_col: str, sink: str, *, model: str = DEFAULT_MODEL, since_version: int | None = None, shadow_mode: bool = False, ledger: Ledger | None = None, key_col: str | None = None, feed: DataFrame | None = None, live_table: DataFrame | None = None, provider_options: dict | None = None, batch: tuple[str, int] | None = None) -> WatchRun:
    """Apply the changes since the last recorded version (exclusive), or since ``since_version`` (inclusive).

    ``feed`` replaces the reader and holds all changes from that version on. With a key, a row's last change counts; without one, a text's last change.

    A text's point goes only when no row has the text any more, so what untouched rows have must be known. It is read from ``live_table`` (the
    source as it stands after the window) if that is given. Else the ledger tells, which keeps a count for each text, with how far it has
    counted: it is believed only if that leaves no gap before this window. Else the source itself is read, as it stood at the window's end, or its whole
    folder of changes; or ``feed``, if it begins with the first version. Where none of these tells, nothing is applied and ValueError raised.
    Whatever tells, the ledger counts on where it left off, so runs of all kinds may follow each other.

    ``batch`` names a stream and the number of its batch, if the feed isn't cut at versions: such a stream is counted by batches, and a ledger is counted either by versions or by one stream.
    The checkpoint is written last, so a crash repeats a window, which changes nothing twice.
    """
    target = open_sink(sink)
    provider(parse_model(model), shadow_mode)
    run, began, spark = WatchRun(source_table, sink), time.monotonic(), get_spark()
    last = ledger.last_watch_version(source_table, sink, model) if ledger else None
    if since_version is None:
        since_version = 0 if last is None else last + 1
    run.since_version = since_version
    rows = window(feed, since_version) if feed is not None else read_feed(spark, source_table, since_version)
    by, start = batch or (VERSIONS, since_version)
    counted = ledger.counted(source_table, sink) if ledger else None
    # without a gap: from the beginning if nothing is counted, else at most one further than what is, by the same measure
    follows = ledger is not None and (start == 0 if counted is None else counted.by == by and start <= counted.to + 1)
    done = counted.to if counted and counted.by == by else -1
    fresh = F.lit(start > done) if batch else F.col("_commit_version") > done
    told = live_table is not None or follows or feed is None or since_version == 0 and batch is None
    if not told:
        if rows.limit(1).count():
            raise ValueError(f"which texts rows before version {since_version} have is unknown: a live table is needed, or a ledger that has counted from the first version on without a gap")
        run.to_version = since_version - 1
        return _finish(run, began, model, ledger)

    with Scratch(spark) as scratch:
        texts = changes_by_text(rows, key_col, text_col, fresh)
        if follows:
            texts = texts.join(ledger.held(source_table, sink), "source_hash", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("change"))
        if ledger:
            texts = texts.join(ledger.known_hashes(model, sink).withColumn("known", F.lit(True)), "source_hash", "left")
        texts = scratch.keep(texts)
        known = F.count_if(F.col("live") & F.col("known")) if ledger else F.lit(0)
        m = texts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in WINDOW_COUNTS), F.max("version").alias("version"), F.count_if("live").alias("n_live"), known.alias("n_known")).first()
        run.n_inserted, run.n_updated, run.n_deleted = (m[c] for c in WINDOW_COUNTS)
        run.to_version = since_version - 1 if m["version"] is None else m["version"]  # -1: not even the first version was there
        if m["version"] is not None:
            retired = texts.where("retired and not live")
            if live_table is None and not follows and feed is None:
                live_table = read_live(spark, source_table, run.to_version)
            if live_table is not None:
                held = live_table.where(F.col(text_col).isNotNull()).select(text_hash(text_col).alias("source_hash"))
            elif follows:
                held = texts.where("n > 0")
            else:
                whole = window(read_feed(spark, source_table, 0), 0, run.to_version) if feed is None else feed
                held = holders(whole, text_col).where("n > 0")
            gone = scratch.keep(retired.join(held.select("source_hash"), "source_hash", "left_anti").select(point_id("source_hash").alias("point_id")))
            inner = EmbedRun(model, sink, n_rows_processed=m["n_live"], n_rows_deduped=m["n_known"])
            wanted = texts.where("live and known is null" if ledger else "live").select("source_hash")
            source = feed if feed is not None else read_feed(spark, source_table, since_version)
            new = one_per_text(addressed(source.select(text_col), text_col).join(wanted, "source_hash", "left_semi"))
            renew(new, gone, inner, target, scratch, shadow_mode=shadow_mode, ledger=ledger, provider_options=provider_options)
            inner.duration_s = time.monotonic() - began
            if follows:
                to = max(done, start if batch else run.to_version)
                ledger.count_holders(texts.where("change <> 0").select("source_hash", "n"), source_table, sink, Counted(by, to))
            record(ledger, inner)
    return _finish(run, began, model, ledger)


def _finish(run: WatchRun, began: float, model: str, ledger: Ledger | None) -> WatchRun:
    run.duration_s = time.monotonic() - began
    if ledger:
        ledger.write_watch_run(**{k: getattr(run, k) for k in ("run_id", "timestamp", "source_table", "sink", "since_version", "to_version", "n_inserted", "n_updated", "n_deleted", "duration_s")}, model=model)
    return run

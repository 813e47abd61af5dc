"""Command line: embed, watch, status and migrate."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from loomvec.plans.embed import embed
from loomvec.plans.ledger import Ledger, recent_runs, status
from loomvec.plans.migrate import STRATEGIES, migrate
from loomvec.plans.session import get_spark
from loomvec.plans.watch import DEFAULT_MODEL, watch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomvec", description=__doc__)
    top.add_argument("--ledger", default=str(Path.home() / ".loomvec"), help="folder of the ledger's tables")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("embed", help="embed a text column into a collection")
    e.add_argument("--table", required=True, help="catalog table, or path of Parquet files")
    e.add_argument("--text-col", required=True)
    e.add_argument("--model", required=True)
    e.add_argument("--sink", required=True)
    e.add_argument("--batch-size", type=int, default=128)
    e.add_argument("--no-dedup", action="store_true")
    e.add_argument("--shadow-mode", action="store_true")
    w = sub.add_parser("watch", help="apply a table's changes to a collection")
    w.add_argument("--table", required=True)
    w.add_argument("--text-col", required=True)
    w.add_argument("--key-col")
    w.add_argument("--live-table", help="the table as it stands: catalog table, or path of Parquet files (default: the ledger counts who has a text)")
    w.add_argument("--sink", required=True)
    w.add_argument("--model", default=DEFAULT_MODEL)
    w.add_argument("--since-version", type=int)
    w.add_argument("--shadow-mode", action="store_true")
    s = sub.add_parser("status", help="show recent runs")
    s.add_argument("--sink")
    s.add_argument("--limit", type=int, default=5)
    m = sub.add_parser("migrate", help="move a collection to another model")
    m.add_argument("--from", dest="from_model", required=True)
    m.add_argument("--to", dest="to_model", required=True)
    m.add_argument("--sink", required=True)
    m.add_argument("--strategy", default="dual-write", choices=STRATEGIES)
    m.add_argument("--adapter-dir", help="folder to keep an adapter in")
    m.add_argument("--shadow-mode", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = get_spark()
    ledger = Ledger(spark, a.ledger)
    try:
        if a.command == "embed":
            df = spark.read.parquet(a.table) if "/" in a.table else None
            run = embed(df, a.text_col, a.model, a.sink, source_table=a.table, dedup=not a.no_dedup, batch_size=a.batch_size, shadow_mode=a.shadow_mode, ledger=ledger)
            print(f"run {run.run_id}\nrows {run.n_rows_processed}, known {run.n_rows_deduped}, repeated {run.n_in_batch_dupes}, null {run.n_null}\ncost ${run.cost_usd:.6f}, {run.duration_s:.1f} s")
        elif a.command == "watch":
            run = watch(a.table, a.text_col, a.sink, model=a.model, since_version=a.since_version, shadow_mode=a.shadow_mode, ledger=ledger, key_col=a.key_col, live_table=(spark.read.parquet(a.live_table) if "/" in a.live_table else spark.table(a.live_table)) if a.live_table else None)
            print(f"run {run.run_id}\nversions {run.since_version} to {run.to_version}: {run.n_inserted} inserted, {run.n_updated} updated, {run.n_deleted} deleted, {run.duration_s:.1f} s")
        elif a.command == "status":
            runs = ledger.runs.read()
            rows = status(recent_runs(runs, a.sink, a.limit) if a.sink else runs, a.limit).withColumn("line", F.concat_ws("  ", "run_id", "at", "model", "n_rows", "n_deduped", "cost_usd", "duration_s")).collect()
            print("\n".join(r["line"] for r in rows) or "No runs found")
        else:
            run = migrate(a.from_model, a.to_model, a.sink, strategy=a.strategy, shadow_mode=a.shadow_mode, ledger=ledger, adapter_dir=a.adapter_dir)
            print(f"run {run.run_id}\n{run.n_source} points, {run.n_migrated} migrated, {run.n_skipped} without text" + (f", recall {run.arr:.4f}" if run.arr is not None else ""))
            print(f"next: read from {run.sink_v2}, then retire {run.sink}" if run.sink_v2 else f"next: apply {run.adapter_path} to new queries" if run.adapter_path else "next: choose a strategy")
    except (ValueError, RuntimeError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

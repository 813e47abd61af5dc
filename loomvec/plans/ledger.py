"""Lineage and cost ledger: runs, provenance, change-feed checkpoints and migrations as keyed tables in one folder."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.sources.keyed import KeyedTable
from loomvec.sources.schemas import EMBED_RUNS, HOLDERS, MIGRATE_RUNS, PROVENANCE, WATCH_RUNS

MONEY = "decimal(18,6)"


def cost_by_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.sum(F.col("cost_usd").cast(MONEY)).alias("cost_usd"))


def recent_runs(runs: DataFrame, sink: str, limit: int = 5) -> DataFrame:
    return runs.where(F.col("sink") == sink).orderBy(F.desc("timestamp"), "run_id").limit(limit)


def known_hashes(provenance: DataFrame, runs: DataFrame, model: str, sink: str) -> DataFrame:
    """Distinct hashes of texts that some run has embedded with this model into this sink."""
    own = runs.where((F.col("model") == model) & (F.col("sink") == sink)).select("run_id")
    return provenance.join(own, "run_id", "left_semi").select("source_hash").distinct()


def lineage(provenance: DataFrame, runs: DataFrame) -> DataFrame:
    """Every embedding with the run that made it."""
    return provenance.select("embedding_id", "source_pk", "source_hash", "run_id", "created_at").join(runs.select("run_id", "model", "sink", "timestamp", "cost_usd"), "run_id")


def last_versions(watch_runs: DataFrame) -> DataFrame:
    """(source_table, sink, to_version): of the latest run by time, which needn't have the largest version."""
    return watch_runs.groupBy("source_table", "sink").agg(F.max_by("to_version", F.struct("timestamp", "run_id")).alias("to_version"))


def status(runs: DataFrame, limit: int = 5) -> DataFrame:
    """The latest runs, formatted for a terminal."""
    return runs.orderBy(F.desc("timestamp"), "run_id").limit(limit).select(
        "run_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "model", "n_rows", "n_deduped", F.format_string("%.4f", F.col("cost_usd").cast("double")).alias("cost_usd"),
        F.format_string("%.1f", F.col("duration_s").cast("double")).alias("duration_s"),
    )


class Counted(NamedTuple):
    """How far the holders of a table's texts are counted without a gap: up to version ``to``, or up to batch ``to`` of the stream that ``by`` names."""

    by: str
    to: int


VERSIONS = "versions"


class Ledger:
    """Usable as a context manager; ``path`` may be a string or a Path. Tables appear when first written."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark = spark
        of = lambda name, schema, keys: KeyedTable(spark, f"{path}/{name}", schema, keys)
        self.runs = of("embed_runs", EMBED_RUNS, ["run_id"])
        self.provenance_table = of("embedding_provenance", PROVENANCE, ["embedding_id", "model", "sink"])
        self.watch_runs = of("watch_runs", WATCH_RUNS, ["run_id"])
        self.holders = of("held_texts", HOLDERS, ["source_table", "sink", "source_hash"])
        self.migrate_runs = of("migrate_runs", MIGRATE_RUNS, ["run_id"])

    def _one(self, table: KeyedTable, row: dict) -> None:
        table.upsert(self.spark.range(0, 1, 1, 1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema)), unique=True)

    def write_run(self, **row) -> None:
        self._one(self.runs, {"timestamp": datetime.now(UTC), "state": "done"} | row)

    def write_watch_run(self, **row) -> None:
        self._one(self.watch_runs, {"timestamp": datetime.now(UTC)} | row)

    def write_migrate_run(self, **row) -> None:
        self._one(self.migrate_runs, {"timestamp": datetime.now(UTC)} | row)

    def write_provenance(self, rows: DataFrame) -> None:
        """The latest run of a text with a model into a sink is the one that counts."""
        self.provenance_table.upsert(rows)

    def forget(self, ids: DataFrame, model: str, sink: str) -> None:
        """Deleted points lose their provenance, so that their texts are embedded when they come back."""
        self.provenance_table.delete(ids.select(F.col("point_id").alias("embedding_id"), F.lit(model).alias("model"), F.lit(sink).alias("sink")))

    def trace(self, made: DataFrame, gone: DataFrame, run_id: str, at: datetime, model: str, sink: str) -> None:
        """Provenance of the points (point_id, source_hash) that a run has made, and none for those (point_id) that it deleted, in one commit."""
        new = made.select("point_id", "source_hash", F.lit(False).alias("__gone"))
        rows = new.unionByName(gone.select("point_id", F.lit(None).cast("string").alias("source_hash"), F.lit(True).alias("__gone")))
        self.provenance_table.apply(rows.select(F.col("point_id").alias("embedding_id"), F.col("point_id").alias("source_pk"), "source_hash", F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), F.lit(sink).alias("sink"), F.lit(at).cast("timestamp").alias("created_at"), "__gone"))

    def counted(self, source_table: str, sink: str) -> Counted | None:
        """How far ``count_holders`` has come for this table and sink; None if it has never begun."""
        own = self.holders.read().where((F.col("source_table") == source_table) & (F.col("sink") == sink) & (F.col("source_hash") == ""))
        row = own.select("counted_by", "n").first()
        return Counted(row["counted_by"], row["n"]) if row else None

    def held(self, source_table: str, sink: str) -> DataFrame:
        """(source_hash, n): how many rows of the table have a text, as far as is counted; texts that none has aren't there."""
        return self.holders.read().where((F.col("source_table") == source_table) & (F.col("sink") == sink) & (F.col("source_hash") != "")).select("source_hash", "n")

    def count_holders(self, now: DataFrame, source_table: str, sink: str, counted: Counted) -> None:
        """New counts (source_hash, n) of texts, and in the same commit how far the count has come: what is told is true or not there."""
        rows = now.select("source_hash", "n", F.lit(None).cast("string").alias("counted_by"), (F.col("n") == 0).alias("__gone"))
        mark = self.spark.range(0, 1, 1, 1).select(F.lit("").alias("source_hash"), F.lit(counted.to).cast("long").alias("n"), F.lit(counted.by).alias("counted_by"), F.lit(False).alias("__gone"))
        self.holders.apply(rows.union(mark).select(F.lit(source_table).alias("source_table"), F.lit(sink).alias("sink"), "source_hash", "n", "counted_by", "__gone"))

    def known_hashes(self, model: str, sink: str) -> DataFrame:
        return known_hashes(self.provenance_table.read(), self.runs.read().where(F.col("state") == "done"), model, sink)

    def hash_exists(self, source_hash: str, model: str, sink: str) -> bool:
        return bool(self.known_hashes(model, sink).where(F.col("source_hash") == source_hash).limit(1).count())

    def cost_by_model(self) -> DataFrame:
        return cost_by_model(self.runs.read())

    def recent_runs(self, sink: str, limit: int = 5) -> DataFrame:
        return recent_runs(self.runs.read(), sink, limit)

    def provenance(self, embedding_id: str) -> dict | None:
        row = lineage(self.provenance_table.read(), self.runs.read()).where(F.col("embedding_id") == embedding_id).orderBy(F.desc("timestamp")).first()
        return row.asDict() if row else None

    def last_watch_version(self, source_table: str, sink: str, model: str | None = None) -> int | None:
        own = self.watch_runs.read().where((F.col("source_table") == source_table) & (F.col("sink") == sink))
        row = last_versions(own if model is None else own.where(F.col("model") == model)).first()
        return row["to_version"] if row else None

    def close(self) -> None:
        """Nothing is held open."""

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_) -> None:
        self.close()

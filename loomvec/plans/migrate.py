"""Moving a collection to another model: rewrite it, adapt new queries to it, or measure both side by side."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvec.functions.text import parse_model, parse_sink, v2_uri
from loomvec.functions.vectors import nearest
from loomvec.operators.adapter import fit, predict, sample_pairs
from loomvec.operators.dedup import addressed, one_per_text
from loomvec.operators.evaluate import check, overlap, split_traffic
from loomvec.plans.embed import embed
from loomvec.plans.ledger import Ledger
from loomvec.plans.providers import provider
from loomvec.plans.session import get_spark, materialised
from loomvec.sources.sinks import open_sink

STRATEGIES = ("dual-write", "adapter", "shadow-eval")
LEAST_PAIRS = 20


@dataclass
class MigrateRun:
    from_model: str
    to_model: str
    sink: str
    strategy: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: datetime = field(default_factory=lambda: datetime.now(UTC))
    sink_v2: str = ""
    n_source: int = 0
    n_migrated: int = 0
    n_skipped: int = 0
    arr: float | None = None
    delta: float | None = None
    delta_low: float | None = None
    delta_high: float | None = None
    gate_informative: bool = True
    adapter_path: str = ""
    duration_s: float = 0.0


def with_text(collection: DataFrame) -> DataFrame:
    """Points that hold their text: what can be embedded again."""
    return collection.where(F.length("source_text") > 0)


def split(rows: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """``rows`` (bounded: a sample) with ``fold``: ``fit`` for the first share in hash order, ``validate`` for the rest."""
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("fold", F.when(at <= F.floor(n * share), "fit").otherwise("validate"))


def migrate(from_model: str, to_model: str, sink: str, *, strategy: str = "dual-write", shadow_mode: bool = False, ledger: Ledger | None = None, sample: int = 5000, k: int = 10, threshold: float | None = 0.97, adapter_dir: str | Path | None = None, share: float = 0.5, vectors: Callable[[DataFrame, str], DataFrame] | None = None, options: dict[str, dict] | None = None) -> MigrateRun:
    """Migrate ``sink`` from one model to another; nothing is switched over.

    ``shadow-eval`` measures how many of the old model's neighbours the new one finds (``arr``), and, with each query sent to one of the two as its hash says (a
    ``share`` of them to the new one), by how much their recall differs, with an interval for that.
    ``vectors`` (rows, model name) replaces the providers when fitting or measuring; ``options`` has provider options by model.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    parse_model(from_model), parse_model(to_model), parse_sink(sink)
    if strategy == "adapter" and adapter_dir is None:
        raise ValueError("the adapter strategy needs adapter_dir, a folder to keep the adapter in")
    target, spark = open_sink(sink), get_spark()
    run, began, options = MigrateRun(from_model, to_model, sink, strategy), time.monotonic(), options or {}

    def made(rows: DataFrame, model: str) -> DataFrame:
        if vectors:
            return vectors(rows, model)
        parsed = parse_model(model)
        return provider(parsed, shadow_mode)(rows, parsed, 128, **options.get(model, {}))

    collection = materialised(target.texts(spark))
    n = collection.agg(F.count("*").alias("all"), F.count_if(F.length("source_text") > 0).alias("text")).first()
    run.n_source, run.n_skipped = n["all"], n["all"] - n["text"]
    if strategy == "dual-write":
        run.sink_v2 = v2_uri(sink)
        if n["text"]:
            done = embed(with_text(collection), "source_text", to_model, run.sink_v2, dedup=False, stable=True, shadow_mode=shadow_mode, ledger=ledger, provider_options=options.get(to_model))
            run.n_migrated = done.n_rows_processed - done.n_in_batch_dupes
    else:
        texts = addressed(with_text(collection).select("source_text"), "source_text")
        chosen = sample_pairs(texts.select("source_hash").distinct(), sample, "source_hash")
        # as many hashes as the sample has; of the texts only the sample's are shuffled
        pairs = materialised(one_per_text(texts.join(F.broadcast(chosen), "source_hash", "left_semi")))
        size = pairs.count()
        if size < LEAST_PAIRS:
            raise ValueError(f"{size} texts are too few to compare two models: at least {LEAST_PAIRS} are needed")
        both = made(pairs, from_model).select("source_hash", F.col("vector").alias("old")).join(made(pairs, to_model).select("source_hash", F.col("vector").alias("new")), "source_hash")
        both = materialised(split(both, "source_hash").withColumn("id", F.xxhash64("source_hash")))
        held = both.where("fold = 'validate'")
        n_held = size - int(size * 0.9)
        k = min(k, n_held - 1)
        run.gate_informative = n_held >= 2 * k + 1  # else almost any two neighbour lists overlap
        old, new = held.select("id", F.col("old").alias("vector")), held.select("id", F.col("new").alias("vector"))
        if strategy == "adapter":
            adapter = fit(both.where("fold = 'fit'"))
            run.arr = check(old, predict(new, adapter.r).select("id", F.col("adapted").alias("vector")), k, threshold)
            run.adapter_path = str(Path(adapter_dir) / f"adapter_{run.run_id[:8]}.npy")
            adapter.save(run.adapter_path)
        else:
            truth = materialised(nearest(old, old, k))
            run.arr = float(overlap(truth, nearest(new, new, k), k).agg(F.avg("recall").alias("r")).first()["r"])
            asked = held.select("id", F.col("old").alias("vector_old"), F.col("new").alias("vector_new"))
            found = split_traffic(asked, truth, old, new, k, share=share).first()
            run.delta, run.delta_low, run.delta_high = found["delta"], found["delta_low"], found["delta_high"]
    run.duration_s = time.monotonic() - began
    if ledger:
        ledger.write_migrate_run(**{c: getattr(run, c) for c in ("run_id", "timestamp", "from_model", "to_model", "sink", "sink_v2", "strategy", "n_source", "n_migrated", "n_skipped", "arr", "duration_s")})
    return run

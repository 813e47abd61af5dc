"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch on its way from Spark to Python.
BATCH_ROWS = 1000
#: Rows that a Python operator holds at once, whatever the size of Spark's batches.
BLOCK_ROWS = 256
#: Bytes of text that a Python operator holds at once (a longer text makes a block of its own).
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in this one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomvec-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


#: Files that ``checkpointed`` has written for whoever asked to be told.
_WRITTEN: list[list[str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends here, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _WRITTEN:
        path = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        _WRITTEN[-1].extend([path.get()] if path.isDefined() else [])
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet, which is smaller than a checkpoint, and read from there. ``Scratch`` deletes it unless told to ``keep`` it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _WRITTEN and not keep:
        _WRITTEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """What is checkpointed inside the ``with`` block is deleted at its end: for work whose result has been written by then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        _WRITTEN.append([])

    def __exit__(self, *_) -> None:
        for path in _WRITTEN.pop():
            delete_folder(self.spark, path)


def in_one_task(sample: DataFrame, order: list[str], train: Callable[[pa.Table], bytes]) -> bytes:
    """``train`` applied, in a task on an executor, to all rows of a bounded sample in a fixed order; its result comes to the driver.

    The driver holds no training data, and a lost executor means one more try. Without rows ``train`` gets an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_pydict({"model": pa.array([train(pa.Table.from_batches(held))], pa.binary())})

    rows = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(trimmed(run), "model binary").collect()
    return bytes(rows[0]["model"]) if rows else b""


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which lives on, gives the memory it has freed back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it is read in fewer pieces than there are cores: a small table in one file is one piece.

    Larger tables, whose scans have pieces enough, are left as they are and nothing of them is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` unchanged, with the session told to hand texts to Python in batches of at most BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(BATCH_ROWS))
    return df


def crc_remainder(col: str | Column, m: int) -> Column:
    """crc32 of the value as text, modulo ``m``; null stays null."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")) % m


def hash_fraction(col: str | Column, share: float, seed: str) -> Column:
    """True for a deterministic pseudo-random ``share`` of the values: the same rows at every run and retry."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(F.lit(seed), c.cast("string")), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold few enough rows and bytes of ``text``."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > BLOCK_BYTES or i - start >= BLOCK_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)

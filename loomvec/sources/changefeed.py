"""Row-level change feeds: readers, metrics in one pass, and the net change of a window of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomvec.functions.text import text_hash

INSERT, PRE, POST, DELETE = "insert", "update_preimage", "update_postimage", "delete"
WINDOW_COUNTS = {"n_inserted": INSERT, "n_updated": POST, "n_deleted": DELETE}


def _change() -> Column:
    """What a change adds to the number of rows that have its text."""
    return F.when(F.col("_change_type").isin(INSERT, POST), 1).when(F.col("_change_type").isin(DELETE, PRE), -1).otherwise(0)


def _tracked(spark: SparkSession, source: str) -> bool:
    """Whether ``source`` is a table of a format that tracks changes, not a folder of changes."""
    if "/" not in source:
        return True
    log = spark._jvm.org.apache.hadoop.fs.Path(source.rstrip("/"), "_delta_log")
    return log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log)


def read_live(spark: SparkSession, source: str, version: int) -> DataFrame | None:
    """The table itself as it stood at ``version``; None if ``source`` is a folder of changes."""
    if not _tracked(spark, source):
        return None
    at = spark.read.format("delta").option("versionAsOf", version)
    return at.load(source) if "/" in source else at.table(source)


def read_feed(spark: SparkSession, source: str, since_version: int = 0) -> DataFrame:
    """Changes from ``since_version`` on (inclusive).

    ``source`` is a folder of Parquet changes (best partitioned by ``_commit_version``), or else a table, by name or by path, of a format
    with change data feeds, for which the session needs that format's connector (not in the test environment: unverified).
    """
    tracked = spark.read.format("delta").option("readChangeFeed", "true").option("startingVersion", since_version)
    if _tracked(spark, source):
        return tracked.load(source) if "/" in source else tracked.table(source)
    return spark.read.parquet(source).where(F.col("_commit_version") >= since_version)


def window(feed: DataFrame, since_version: int, to_version: int | None = None) -> DataFrame:
    rows = feed.where(F.col("_commit_version") >= since_version)
    return rows if to_version is None else rows.where(F.col("_commit_version") <= to_version)


def upserts(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("_change_type").isin(INSERT, POST))


def deletes(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("_change_type") == DELETE)


def metrics(feed: DataFrame, since_version: int = 0) -> DataFrame:
    """One row, one pass: n_inserted, n_updated, n_deleted, to_version (``since_version`` if the feed is empty)."""
    n = lambda kind: F.count_if(F.col("_change_type") == kind)
    return feed.agg(n(INSERT).alias("n_inserted"), n(POST).alias("n_updated"), n(DELETE).alias("n_deleted"), F.coalesce(F.max("_commit_version"), F.lit(since_version)).cast("long").alias("to_version"))


def holders(feed: DataFrame, text: str) -> DataFrame:
    """(source_hash, n): by how many rows more (or fewer) have a text after the feed; of a whole feed, how many have it."""
    return feed.where(F.col(text).isNotNull()).groupBy(text_hash(text).alias("source_hash")).agg(F.sum(_change()).cast("long").alias("n"))


def changes_by_text(feed: DataFrame, key: str | None, text: str, counts: Column) -> DataFrame:
    """(source_hash, live, retired, change, and the window's counts by text) of each text of a window, in one pass over it.

    ``live``: it is what some key has at last (without keys: its own last change leaves it); ``retired``: some row stopped having it; ``change``: by how many rows more
    have it, of the changes for which ``counts`` holds. What is null is a row too: neither live nor retired, with counts.
    """
    rows = feed.withColumn("source_hash", text_hash(text))
    stops, pre = F.col("_change_type").isin(DELETE, PRE), F.col("_change_type") == PRE
    kinds = {name: F.count_if(F.col("_change_type") == kind).alias(name) for name, kind in WINDOW_COUNTS.items()}
    sums = [F.max(stops).alias("retired"), F.sum(F.when(counts, _change()).otherwise(0)).cast("long").alias("change"), *kinds.values(), F.max("_commit_version").alias("version")]
    some = F.col("source_hash").isNotNull()
    if key is None:
        last = F.max(F.struct("_commit_version", (~stops).alias("alive")))
        out = rows.groupBy("source_hash").agg(last.alias("o"), *sums)
        return out.select("source_hash", (some & F.col("o.alive")).alias("live"), (some & F.col("retired")).alias("retired"), "change", *kinds, "version")
    last = F.max(F.when(~pre, F.struct("_commit_version", (F.col("_change_type") != DELETE).alias("alive"), "source_hash")))
    of_key = rows.groupBy(F.col(key).alias("key"), "source_hash").agg(last.alias("o"), *sums)
    of_key = of_key.withColumn("last", F.max("o").over(Window.partitionBy("key")))
    ends = F.coalesce((F.col("o") == F.col("last")) & F.col("o.alive"), F.lit(False))
    out = of_key.groupBy("source_hash").agg(F.max(ends).alias("live"), F.max("retired").alias("retired"), *(F.sum(c).alias(c) for c in ("change", *kinds)), F.max("version").alias("version"))
    return out.withColumns({c: some & F.col(c) for c in ("live", "retired")})


def net_changes(feed: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, live): what each key's last change in the window leaves; a preimage never counts as the last.

    Versions order changes; within one version a delete comes before an insert of the same key.
    """
    order = F.struct("_commit_version", (F.col("_change_type") != DELETE).alias("alive"), F.col(text).alias("text"))
    last = feed.where(F.col("_change_type") != PRE).groupBy(key).agg(F.max(order).alias("o"))
    return last.select(key, F.col("o.text").alias(text), F.col("o.alive").alias("live"))


def retired_texts(feed: DataFrame, text: str) -> DataFrame:
    """Distinct texts that some row stopped having in the window: deleted rows and preimages of updates."""
    return feed.where(F.col("_change_type").isin(DELETE, PRE)).select(text).distinct()


def orphans(feed: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct texts that no row has after the window, of those that some row stopped having in it.

    ``feed`` must hold the table's whole history for texts of untouched rows to count; else join the result with the live table.
    """
    live = net_changes(feed, key, text).where("live").select(text).distinct()
    return retired_texts(feed, text).join(live, text, "left_anti")

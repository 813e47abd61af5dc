"""Inputs that the queries need and the test data lacks, derived from whole tables; each as a DataFrame and as SQL.

``doc_id % n`` below assigns roles (which documents an earlier run has embedded, which change in which version);
every document takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions.text import point_id, text_hash
from loomvec.functions.vectors import dot

#: Models of the runs derived from events: three with a price and one without.
MODELS = {"view": "openai/text-embedding-3-small", "click": "openai/text-embedding-3-large", "purchase": "openai/text-embedding-ada-002"}
OTHER_MODEL = "openai/text-embedding-next"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a stream, whether the table is one file or a folder of files: a stream takes a single file only by a pattern."""
    rows = spark.readStream.schema(table(spark, sf_dir, "documents").schema)
    return rows.parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text", "source")


def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("doc_id % 3 = 0").select(text_hash("text").alias("source_hash")).distinct()


KNOWN = "known AS (SELECT DISTINCT md5(text) AS source_hash FROM documents WHERE doc_id % 3 = 0)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.lit(OTHER_MODEL)
    for kind, name in MODELS.items():
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("timestamp"), model.alias("model"), F.concat(F.lit("file:///sink_"), (F.col("user_id") % 5).cast("string")).alias("sink"),
        n.alias("n_rows"), F.expr("0L").alias("n_deduped"), F.col("value").alias("cost_usd"), "event_type", "user_id", "event_id",
    )


_CASE = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{m}'" for k, m in MODELS.items()) + f" ELSE '{OTHER_MODEL}' END"
RUNS = f"runs AS (SELECT CAST(event_id AS VARCHAR) AS run_id, ts AS timestamp, {_CASE} AS model, 'file:///sink_' || CAST(user_id % 5 AS VARCHAR) AS sink, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS n_rows, value AS cost_usd, event_type, user_id, event_id FROM events)"


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").agg((F.max("event_id") + 1).alias("n"))
    texts = documents(spark, sf_dir).groupBy(text_hash("text").alias("source_hash")).agg(F.min("doc_id").alias("doc_id"))
    # the right side is one row
    return texts.join(F.broadcast(n)).select(point_id("source_hash").alias("embedding_id"), point_id("source_hash").alias("source_pk"), "source_hash", (F.col("doc_id") % F.col("n")).cast("string").alias("run_id"), F.lit(None).cast("timestamp").alias("created_at"))


def pid(h: str) -> str:
    """The point id of a hash, in DuckDB's SQL."""
    s = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({h}))"
    return f"concat(substr({s}, 1, 8), '-', substr({s}, 9, 4), '-5', substr({s}, 14, 3), '-', translate(substr({s}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({s}, 18, 3), '-', substr({s}, 21, 12))"


PROVENANCE = f"prov AS (SELECT {pid('source_hash')} AS embedding_id, source_hash, CAST(doc_id % (SELECT max(event_id) + 1 FROM events) AS VARCHAR) AS run_id FROM (SELECT md5(text) AS source_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1))"


def watch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).where("event_type = 'view'")
    return rows.select("run_id", "timestamp", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("source_table"), "sink", (F.col("event_id") % 100).alias("to_version"))


WATCH_RUNS = "watch_runs AS (SELECT run_id, timestamp, 't' || CAST(user_id % 3 AS VARCHAR) AS source_table, sink, event_id % 100 AS to_version FROM runs WHERE event_type = 'view')"


def feed_of(docs: DataFrame) -> DataFrame:
    """A change feed of four versions that every document takes part in, made in one pass."""
    r = F.col("doc_id") % 10
    change = lambda when, kind, version, text=F.col("text"): F.when(when, F.struct(text.alias("text"), F.lit(kind).alias("_change_type"), F.lit(version).cast("long").alias("_commit_version")))
    changes = F.array_compact(F.array(
        change(r < 8, "insert", 0), change(r == 8, "insert", 1), change(r == 0, "update_preimage", 1), change(r == 0, "update_postimage", 1, F.concat("text", F.lit(" [rev1]"))),
        change(r == 1, "delete", 2), change(r == 9, "insert", 2), change(F.col("doc_id") % 20 == 1, "insert", 3),
    ))
    return docs.select("doc_id", F.explode(changes).alias("c")).select("doc_id", "c.text", "c._change_type", "c._commit_version")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_of(documents(spark, sf_dir))


_PART = "SELECT doc_id, {text} AS text, '{kind}' AS _change_type, CAST({version} AS BIGINT) AS _commit_version FROM documents WHERE {where}"
FEED = "feed AS (" + " UNION ALL ".join(_PART.format(where=w, kind=k, version=v, text=t) for w, k, v, t in [
    ("doc_id % 10 < 8", "insert", 0, "text"), ("doc_id % 10 = 8", "insert", 1, "text"), ("doc_id % 10 = 0", "update_preimage", 1, "text"), ("doc_id % 10 = 0", "update_postimage", 1, "text || ' [rev1]'"),
    ("doc_id % 10 = 1", "delete", 2, "text"), ("doc_id % 10 = 9", "insert", 2, "text"), ("doc_id % 20 = 1", "insert", 3, "text"),
]) + ")"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


#: Normal of the mirror in ``turned``, for vectors of 64.
MIRROR = [float(37 * i % 11 - 5) for i in range(64)]
_SCALE = 2 / sum(x * x for x in MIRROR)


def turned(df: DataFrame) -> DataFrame:
    """The new model's vectors: each old one mirrored, then turned by one position. The map is orthogonal, not symmetric, and mixes all components."""
    u = F.array(*map(F.lit, MIRROR))
    df = df.withColumn("__c", dot("vector", u) * _SCALE).withColumn("vector", F.zip_with("vector", u, lambda x, y: x - F.col("__c") * y)).drop("__c")
    return df.withColumn("vector", F.concat(F.slice("vector", 2, F.size("vector") - 1), F.slice("vector", 1, 1)))


_U = f"{MIRROR}::DOUBLE[]"
VECTORS = f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), mirrored AS (SELECT id, [z[1] - c * z[2] for z in list_zip(v, {_U})] AS v FROM (SELECT id, v, {_SCALE!r} * list_inner_product(v, {_U}) AS c FROM e)), s AS (SELECT id, list_concat(v[2:], v[:1]) AS v FROM mirrored)"
#: The cells of the matrix that takes the new vectors back to the old ones.
BACK = f"back AS (SELECT i, j, CASE WHEN i = (j + 1) % 64 THEN 1 ELSE 0 END - {_SCALE!r} * ({_U})[i + 1] * ({_U})[(j + 1) % 64 + 1] AS r FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j))"

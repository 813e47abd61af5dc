"""Vector collections behind one protocol, chosen by the URI's scheme.

``file`` keeps a collection as a keyed table and is what the tests exercise. ``qdrant`` and ``pg`` write from the
executors with clients imported there; no such server or client is in the test environment, so they are unverified beyond their
URI handling and SQL text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions.text import parse_sink, postgres_target
from loomvec.sources.keyed import KeyedTable
from loomvec.sources.schemas import POINTS

WRITE_BATCH = 256


class Sink(Protocol):
    def upsert(self, points: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...

    def texts(self, spark: SparkSession) -> DataFrame: ...


class FileSink:
    def __init__(self, uri: str):
        parsed = parse_sink(uri)
        if not parsed.collection:
            raise ValueError(f"sink {uri!r} names no collection")
        self.path = parsed.path if parsed.scheme == "file" else uri

    def table(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, self.path, POINTS, ["point_id"])

    def upsert(self, points: DataFrame) -> None:
        """Of several points with one id the one made last stays."""
        self.table(points.sparkSession).upsert(points, last_by="created_at")

    def put(self, points: DataFrame, merge: bool = True) -> None:
        """Points of which no two have one id: none has to be looked for, so nothing is shuffled."""
        self.table(points.sparkSession).upsert(points, unique=True, merge=merge)

    def refresh(self, points: DataFrame, gone: DataFrame) -> None:
        """Both at once: a reader sees all of it or nothing."""
        gone = gone.select("point_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in POINTS if f.name != "point_id"), F.lit(True).alias("__gone"))
        self.table(points.sparkSession).apply(points.select(*POINTS.names, F.lit(False).alias("__gone")).unionByName(gone))

    def delete(self, ids: DataFrame) -> None:
        self.table(ids.sparkSession).delete(ids)

    def texts(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).read().select("point_id", "source_text")


def _batches(rows: Iterator, n: int = WRITE_BATCH) -> Iterator[list]:
    while some := list(islice(rows, n)):
        yield some


class QdrantSink:
    def __init__(self, uri: str):
        self.at = parse_sink(uri)
        if not self.at.collection:
            raise ValueError(f"sink {uri!r} names no collection")

    def upsert(self, points: DataFrame) -> None:
        first = points.select(F.size("vector").alias("d")).first()
        if first is None:
            return
        at = self.at
        from qdrant_client import QdrantClient, models

        client = QdrantClient(host=at.host, port=at.port)
        if not client.collection_exists(at.collection):
            client.create_collection(at.collection, vectors_config=models.VectorParams(size=first["d"], distance=models.Distance.COSINE))

        def write(rows):
            from qdrant_client import QdrantClient, models

            own = QdrantClient(host=at.host, port=at.port)
            for some in _batches(rows):
                own.upsert(at.collection, points=[models.PointStruct(id=r["point_id"], vector=list(r["vector"]), payload={k: str(r[k]) for k in ("source_text", "source_hash", "embed_run_id", "created_at")}) for r in some])

        points.foreachPartition(write)

    def delete(self, ids: DataFrame) -> None:
        at = self.at

        def write(rows):
            from qdrant_client import QdrantClient, models

            own = QdrantClient(host=at.host, port=at.port)
            for some in _batches(rows):
                own.delete(at.collection, points_selector=models.PointIdsList(points=[r["point_id"] for r in some]))

        ids.foreachPartition(write)

    def texts(self, spark: SparkSession, parts: int = 64) -> DataFrame:
        """Points with their texts, read page by page; ids are spread evenly, so each task scrolls through its own range of them. No collection: no rows."""
        at = self.at

        def read(batches):
            from qdrant_client import QdrantClient

            own = QdrantClient(host=at.host, port=at.port)
            there = own.collection_exists(at.collection)
            for b in batches:
                for part in b.column("id").to_pylist() if there else ():
                    edge = [str(uuid.UUID(int=min((k << 128) // parts, (1 << 128) - 1))) for k in (part, part + 1)]
                    offset = edge[0]
                    while offset is not None:
                        page, offset = own.scroll(at.collection, limit=WRITE_BATCH, offset=offset, with_payload=["source_text"], with_vectors=False)
                        mine = [p for p in page if part == parts - 1 or str(p.id) < edge[1]]
                        yield pa.RecordBatch.from_pydict({"point_id": pa.array([str(p.id) for p in mine], pa.string()), "source_text": pa.array([(p.payload or {}).get("source_text") for p in mine], pa.string())})
                        if len(mine) < len(page):
                            break

        return spark.range(0, parts, 1, parts).mapInArrow(read, "point_id string, source_text string")


class PostgresSink:
    def __init__(self, uri: str):
        self.uri, self.table = postgres_target(uri)

    def statements(self, dim: int) -> tuple[str, str, str]:
        """(create, insert, delete)."""
        create = f"CREATE EXTENSION IF NOT EXISTS vector; CREATE TABLE IF NOT EXISTS {self.table} (id UUID PRIMARY KEY, embedding vector({dim}), source_text TEXT, source_hash TEXT, embed_run_id TEXT, created_at TIMESTAMPTZ)"
        insert = f"INSERT INTO {self.table} (id, embedding, source_text, source_hash, embed_run_id, created_at) VALUES (%s, %s, %s, %s, %s, %s) ON CONFLICT (id) DO NOTHING"
        return create, insert, f"DELETE FROM {self.table} WHERE id = ANY(%s::uuid[])"

    def _each(self, rows: DataFrame, write: Callable) -> None:
        uri = self.uri

        def run(part):
            import psycopg2

            with psycopg2.connect(uri) as link, link.cursor() as cursor:
                for some in _batches(part):
                    write(cursor, some)

        rows.foreachPartition(run)

    def upsert(self, points: DataFrame) -> None:
        first = points.select(F.size("vector").alias("d")).first()
        if first is None:
            return
        import psycopg2

        create, insert, _ = self.statements(first["d"])
        with psycopg2.connect(self.uri) as link, link.cursor() as cursor:
            cursor.execute(create)
        self._each(points, lambda cursor, some: cursor.executemany(insert, [(r["point_id"], str(list(r["vector"])), r["source_text"], r["source_hash"], r["embed_run_id"], r["created_at"]) for r in some]))

    def delete(self, ids: DataFrame) -> None:
        delete = self.statements(0)[2]
        self._each(ids, lambda cursor, some: cursor.execute(delete, ([r["point_id"] for r in some],)))

    def texts(self, spark: SparkSession) -> DataFrame:
        """Points with their texts, read in parallel by ranges of the first digit of the id."""
        url, options = self.jdbc()
        predicates = [f"left(id::text, 1) = '{d}'" for d in "0123456789abcdef"]
        return spark.read.jdbc(url, self.table, predicates=predicates, properties=options).select(F.col("id").cast("string").alias("point_id"), "source_text")

    def jdbc(self) -> tuple[str, dict[str, str]]:
        """The driver's URL, which must not hold user and password, and those as properties."""
        u = urlsplit(self.uri)
        port, query = f":{u.port}" if u.port else "", f"?{u.query}" if u.query else ""
        found = {"user": u.username, "password": u.password}
        return f"jdbc:postgresql://{u.hostname or 'localhost'}{port}{u.path}{query}", {k: unquote(v) for k, v in found.items() if v}


SINKS: dict[str, Callable[[str], Sink]] = {"file": FileSink, "qdrant": QdrantSink, "pg": PostgresSink, "postgresql": PostgresSink}


def put(sink: Sink, points: DataFrame, merge: bool = True) -> None:
    """New points, one for each id; ``merge``: whether a table of many commits may merge them now."""
    if hasattr(sink, "put"):
        sink.put(points, merge)
    else:
        sink.upsert(points)


def refresh(sink: Sink, points: DataFrame, gone: DataFrame) -> None:
    """New points, one for each id, and the ids of others that go."""
    if hasattr(sink, "refresh"):
        sink.refresh(points, gone)
    else:
        sink.upsert(points)
        sink.delete(gone)


def open_sink(uri: str) -> Sink:
    scheme = parse_sink(uri).scheme
    if scheme not in SINKS:
        raise ValueError(f"no sink for scheme {scheme!r}; there are {', '.join(sorted(SINKS))}")
    return SINKS[scheme](uri)

"""The public API on file collections: embed, watch, migrate, ledger and command line."""

import urllib.error
import uuid
import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import loomvec
from loomvec.functions import text as names
from loomvec.functions.vectors import nearest, shadow_vector
from loomvec.operators import adapter, evaluate
from loomvec.plans import providers
from loomvec.plans.cli import main
from loomvec.plans.migrate import migrate
from loomvec.sources import changefeed as cdf
from loomvec.sources.keyed import KeyedTable
from loomvec.sources.schemas import WATCH_RUNS
from loomvec.sources.sinks import PostgresSink, open_sink
from loomvec.streaming.watch_stream import stream_refresh

MODEL = "openai/text-embedding-3-small"
OPTIONS = {"dim": 16}


def pid(text):
    return str(uuid.uuid5(uuid.NAMESPACE_OID, hashlib.md5(text.encode()).hexdigest()))


def texts_in(spark, sink):
    return sorted(r["source_text"] for r in open_sink(sink).texts(spark).collect())


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/docs", str(tmp_path / "ledger")


def test_embed_twice_is_all_known_and_null_texts_are_counted(spark, place):
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "body string")
    go = lambda: loomvec.embed(df, "body", MODEL, sink, shadow_mode=True, ledger=ledger, provider_options=OPTIONS)
    first, second = go(), go()
    assert (first.n_rows_processed, first.n_rows_deduped, first.n_in_batch_dupes, first.n_null) == (4, 0, 1, 1)
    assert (second.n_rows_processed, second.n_rows_deduped, second.n_in_batch_dupes) == (4, 4, 0)
    assert texts_in(spark, sink) == ["", "a", "b"]
    row = ledger.provenance(pid("a"))
    assert row["run_id"] == first.run_id and row["model"] == MODEL and row["cost_usd"] == 0
    assert ledger.hash_exists(hashlib.md5(b"a").hexdigest(), MODEL, sink) and not ledger.hash_exists("0" * 32, MODEL, sink)
    assert ledger.recent_runs(sink).first()["run_id"] == second.run_id and ledger.cost_by_model().first()["cost_usd"] == 0


def test_known_texts_are_known_by_model_and_sink(spark, place, tmp_path):
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    df = spark.createDataFrame([("a",)], "body string")
    other = f"file://{tmp_path}/other"
    go = lambda s: loomvec.embed(df, "body", MODEL, s, shadow_mode=True, ledger=ledger, provider_options=OPTIONS).n_rows_deduped
    assert [go(sink), go(other), go(sink), go(other)] == [0, 0, 1, 1]


def test_a_failed_provider_is_paid_for_one_slice_again(spark, place, tmp_path, monkeypatch):
    """Of four slices one fails: the next run asks only for that one and those after it."""
    sink, path = place
    ledger, bills, mended = loomvec.Ledger(spark, path), tmp_path / "bills", tmp_path / "mended"
    bills.mkdir()
    at, gate = str(bills), str(mended)

    def paid(rows, model, batch_size):
        def run(batches):
            import os

            import pyarrow as pa

            for b in batches:
                for h, t in zip(b.column("source_hash").to_pylist(), b.column("source_text").to_pylist()):
                    if t == "poison" and not os.path.exists(gate):
                        raise OSError("the provider is down")
                    with open(f"{at}/{h}", "a") as f:
                        f.write("x")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[1.0, 0.0]] * b.num_rows, pa.list_(pa.float32())), pa.array([3] * b.num_rows, pa.int64())], names=[*b.schema.names, "vector", "n_tokens"])

        return rows.mapInArrow(run, rows.select("*", F.array(F.lit(0.0).cast("float")).alias("vector"), F.lit(0).cast("long").alias("n_tokens")).schema)

    monkeypatch.setitem(providers.PROVIDERS, "paid", paid)
    df = spark.createDataFrame([("poison",), *((f"text {k}",) for k in range(39))], "body string").repartition(1)
    go = lambda: loomvec.embed(df, "body", "paid/text-embedding-3-small", sink, ledger=ledger, slice_rows=10)
    with pytest.raises(Exception, match="provider is down"):
        go()
    before = len(texts_in(spark, sink))
    mended.touch()
    run = go()
    slices = {r["source_text"]: r["s"] for r in open_sink(sink).texts(spark).select("source_text", F.pmod(F.xxhash64(names.text_hash("source_text")), F.lit(4)).alias("s")).collect()}
    bad = slices["poison"]
    assert len(slices) == 40 and before == run.n_rows_deduped == sum(s < bad for s in slices.values())
    billed = {t: len((bills / hashlib.md5(t.encode()).hexdigest()).read_text()) for t in slices}
    assert all(n == 1 for t, n in billed.items() if slices[t] != bad) and max(billed.values()) <= 2
    assert abs(run.cost_usd - (40 - before) * 3 * 0.02e-6) < 1e-12


def test_embed_empty_and_refusals_come_first(spark, place):
    sink, _ = place
    empty = spark.createDataFrame([], "body string")
    assert loomvec.embed(empty, "body", MODEL, sink, shadow_mode=True).n_rows_processed == 0
    for bad in ({"model": "nameless"}, {"sink": "ftp://x/y"}, {"model": "nobody/x", "shadow_mode": False}, {"sink": "qdrant://host:1/"}):
        with pytest.raises(ValueError):
            loomvec.embed(empty, "body", **({"model": MODEL, "sink": sink, "shadow_mode": True} | bad))
    with pytest.raises(ValueError):
        loomvec.embed(None, "body", MODEL, sink, shadow_mode=True)


FEED = "id long, body string, _change_type string, _commit_version long"


def test_watch_applies_net_changes_and_counts_references(spark, place):
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    rows = [
        (1, "a", "insert", 0), (2, "shared", "insert", 0), (3, "shared", "insert", 0), (4, "old", "insert", 0), (5, "back", "insert", 0),
        (2, "shared", "delete", 1), (4, "old", "update_preimage", 1), (4, "new", "update_postimage", 1), (5, "back", "delete", 1), (5, "back", "insert", 2), (1, "a", "delete", 2),
    ]
    feed = spark.createDataFrame(rows, FEED)
    go = lambda f: loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, ledger=ledger, key_col="id", feed=f, provider_options=OPTIONS)
    run = go(feed)
    assert (run.n_inserted, run.n_updated, run.n_deleted, run.since_version, run.to_version) == (6, 1, 3, 0, 2)
    assert texts_in(spark, sink) == ["back", "new", "shared"]
    again = go(feed)
    assert (again.since_version, again.n_inserted, again.to_version) == (3, 0, 2)
    back = go(feed.union(spark.createDataFrame([(1, "a", "insert", 3)], FEED)))
    assert back.to_version == 3 and "a" in texts_in(spark, sink)  # its provenance went with it


def test_window_alone_keeps_texts_that_live_elsewhere(spark, place):
    sink, _ = place
    loomvec.embed(spark.createDataFrame([("x",), ("y",)], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS)
    feed = spark.createDataFrame([(1, "x", "delete", 5), (2, "y", "delete", 5)], FEED)
    live = spark.createDataFrame([("x",)], "body string")
    loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, key_col="id", feed=feed, live_table=live)
    assert texts_in(spark, sink) == ["x"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abc"), st.booleans()), min_size=1, max_size=12))
def test_net_change_is_the_last_change(spark, steps):
    rows = [(k, t, "insert" if up else "delete", v) for v, (k, t, up) in enumerate(steps)]
    state = {}
    for k, t, up in steps:
        state[k] = t if up else None
    got = {r["id"]: r["body"] for r in cdf.net_changes(spark.createDataFrame(rows, FEED), "id", "body").where("live").collect()}
    assert got == {k: t for k, t in state.items() if t is not None}


def test_stream_equals_batch(spark, place, tmp_path):
    sink, path = place
    spark.createDataFrame([(1, "a", "insert", 0), (2, "b", "insert", 0), (1, "a", "delete", 1)], FEED).coalesce(1).write.parquet(str(tmp_path / "feed"))
    changes = spark.readStream.schema(FEED).parquet(str(tmp_path / "feed"))
    stream_refresh(changes, "body", sink, str(tmp_path / "offsets"), model=MODEL, key_col="id", shadow_mode=True, ledger=loomvec.Ledger(spark, path), provider_options=OPTIONS).awaitTermination()
    assert texts_in(spark, sink) == ["b"]


def test_a_text_that_untouched_rows_have_stays(spark, place):
    """Two windows, the second with only one of two holders: by the ledger's counts, however often a window comes again."""
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    go = lambda rows, **more: loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, ledger=ledger, feed=spark.createDataFrame(rows, FEED), provider_options=OPTIONS, **more)
    go([(1, "shared", "insert", 0), (2, "shared", "insert", 0), (3, "own", "insert", 0)])
    for _ in range(2):
        go([(1, "shared", "delete", 1), (3, "own", "delete", 1)], since_version=1)
        assert texts_in(spark, sink) == ["shared"]
    go([(2, "shared", "update_preimage", 2), (2, "last", "update_postimage", 2)], key_col="id")
    assert texts_in(spark, sink) == ["last"]


def test_nothing_goes_where_holders_are_unknown(spark, place):
    sink, _ = place
    loomvec.embed(spark.createDataFrame([("x",)], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS)
    late = spark.createDataFrame([(1, "x", "delete", 5)], FEED)
    with pytest.raises(ValueError, match="live table"):
        loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, feed=late, since_version=5)
    with pytest.raises(ValueError, match="ledger"):
        stream_refresh(late, "body", sink, "nowhere", model=MODEL)
    assert texts_in(spark, sink) == ["x"]


def test_a_folder_of_changes_tells_who_holds_a_text(spark, place, tmp_path):
    sink, _ = place
    at = str(tmp_path / "changes")
    spark.createDataFrame([(1, "x", "insert", 0), (2, "x", "insert", 0), (3, "y", "insert", 0), (1, "x", "delete", 1), (3, "y", "delete", 1)], FEED).write.parquet(at)
    go = lambda since: loomvec.watch(at, "body", sink, model=MODEL, shadow_mode=True, since_version=since, provider_options=OPTIONS)
    loomvec.embed(spark.createDataFrame([("x",), ("y",)], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS)
    go(1)
    assert texts_in(spark, sink) == ["x"]


V0 = [(1, "shared", "insert", 0), (2, "shared", "insert", 0), (3, "own", "insert", 0)]
V1 = [(1, "shared", "delete", 1), (3, "own", "delete", 1)]
V2 = [(2, "shared", "delete", 2), (4, "own", "insert", 2)]


def live_after(*versions):
    """Texts that rows have after some versions, a row for each."""
    held = {}
    for k, text, kind, _ in (row for v in versions for row in v):
        held[k] = text if kind == "insert" else None
    return [(t,) for t in held.values() if t]


@pytest.mark.parametrize("modes", ["LCC", "CLC", "CCL", "LLC", "WCC", "LWC"])
def test_any_order_of_modes_keeps_what_rows_have(spark, place, modes):
    """Windows that know what rows have by a live table (L), the ledger's counts (C) or all changes (W)."""
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    for k, mode in enumerate(modes):
        versions = [V0, V1, V2][: k + 1]
        rows = spark.createDataFrame(sum(versions, []) if mode == "W" else versions[k], FEED)
        more = {"live_table": spark.createDataFrame(live_after(*versions), "body string")} if mode == "L" else {"since_version": 0} if mode == "W" else {}
        loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, ledger=ledger, feed=rows, key_col="id", provider_options=OPTIONS, **more)
        assert texts_in(spark, sink) == sorted({t for (t,) in live_after(*versions)})


def test_a_ledger_with_a_gap_is_not_believed(spark, place, tmp_path):
    """Counting that began late, by someone else's batches, or not at all: an error, and nothing is deleted."""
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    go = lambda rows, **more: loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, ledger=ledger, feed=spark.createDataFrame(rows, FEED), provider_options=OPTIONS, **more)
    loomvec.embed(spark.createDataFrame([("shared",), ("own",)], "body string"), "body", MODEL, sink, shadow_mode=True, ledger=ledger, provider_options=OPTIONS)
    go(V1, since_version=1, live_table=spark.createDataFrame([("shared",)], "body string"))  # version 0 was never counted
    assert texts_in(spark, sink) == ["shared"] and ledger.counted("t", sink) is None
    with pytest.raises(ValueError, match="without a gap"):
        go([(5, "shared", "delete", 2)])
    with pytest.raises(ValueError, match="without a gap"):
        go([(5, "shared", "delete", 9)], batch=("stream a", 3))
    assert texts_in(spark, sink) == ["shared"]
    go(V0 + V1, since_version=0)
    assert ledger.counted("t", sink) == ("versions", 1)
    go([(2, "shared", "insert", 2)], batch=("stream a", 0), live_table=spark.createDataFrame([("shared",)], "body string"))
    with pytest.raises(ValueError, match="without a gap"):
        go([(2, "shared", "delete", 3)], batch=("stream a", 1))
    with pytest.raises(ValueError, match="without a gap"):
        go([(2, "shared", "delete", 5)], since_version=5)
    assert texts_in(spark, sink) == ["shared"]


def test_a_stream_on_another_checkpoint_deletes_nothing(spark, place, tmp_path):
    sink, path = place
    ledger, at = loomvec.Ledger(spark, path), str(tmp_path / "feed")
    spark.createDataFrame(V0 + [(1, "shared", "delete", 1)], FEED).coalesce(1).write.parquet(at)
    go = lambda offsets: stream_refresh(spark.readStream.schema(FEED).parquet(at), "body", sink, str(tmp_path / offsets), model=MODEL, key_col="id", shadow_mode=True, ledger=ledger, provider_options=OPTIONS).awaitTermination()
    go("one")
    assert ledger.held("t", sink).count() == 0 and {r["n"] for r in ledger.held("stream", sink).collect()} == {1}
    with pytest.raises(Exception, match="without a gap"):
        go("two")
    go("one")
    assert texts_in(spark, sink) == ["own", "shared"] and {r["n"] for r in ledger.held("stream", sink).collect()} == {1}


@pytest.mark.parametrize("seed, cut", [(0, 1), (1, 4), (2, 8)])
def test_counts_follow_the_table(spark, tmp_path_factory, seed, cut):
    """Rows inserted, updated and deleted, in two windows: counts and points are those of the table, and a window that comes again changes nothing."""
    import random

    rng = random.Random(seed)
    steps = [(9, "late", False)] * (seed == 0) + [(rng.randrange(4), rng.choice(["x", "y", None]), rng.random() < 0.7) for _ in range(12)]
    sink = f"file://{tmp_path_factory.mktemp('c')}/docs"
    ledger = loomvec.Ledger(spark, str(tmp_path_factory.mktemp("l")))
    table, rows = {}, []
    for v, (k, text, up) in enumerate(steps):
        if up:
            rows += [(k, table[k], "update_preimage", v), (k, text, "update_postimage", v)] if k in table else [(k, text, "insert", v)]
            table[k] = text
        elif k in table:
            rows.append((k, table.pop(k), "delete", v))
    go = lambda some, **more: loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, ledger=ledger, feed=spark.createDataFrame(some, FEED), key_col="id", provider_options=OPTIONS, **more)
    go([r for r in rows if r[3] < cut])
    go([r for r in rows if r[3] >= cut])
    go(rows, since_version=0)
    from collections import Counter

    want = Counter(t for t in table.values() if t is not None)
    assert {r["source_hash"]: r["n"] for r in ledger.held("t", sink).collect()} == {hashlib.md5(t.encode()).hexdigest(): n for t, n in want.items()}
    assert texts_in(spark, sink) == sorted(want)


def test_the_catalog_tells_the_source(spark, place):
    spark.createDataFrame([("from the catalog",), ("from the catalog",), (None,)], "body string").createOrReplaceTempView("posts")
    run = loomvec.embed(None, "body", MODEL, place[0], source_table="posts", shadow_mode=True, provider_options=OPTIONS)
    assert (run.n_rows_processed, run.n_in_batch_dupes, run.n_null) == (2, 1, 1) and texts_in(spark, place[0]) == ["from the catalog"]


def test_of_points_with_one_id_the_last_stays(spark, place):
    from datetime import datetime

    sink = open_sink(place[0])
    rows = [("a", [1.0], f"text {k}", "h", "r", datetime(2024, 1, 1 + k)) for k in (1, 3, 2)]
    sink.upsert(spark.createDataFrame(rows, "point_id string, vector array<float>, source_text string, source_hash string, embed_run_id string, created_at timestamp"))
    assert texts_in(spark, place[0]) == ["text 3"]


def test_two_writers_of_one_commit(spark, tmp_path, monkeypatch):
    """The second is refused, and what it wrote is gone."""
    t, late = (KeyedTable(spark, str(tmp_path / "t"), WATCH_RUNS, ["run_id"]) for _ in range(2))
    row = lambda k: spark.range(1).select(*(F.lit(k).alias("run_id") if f.name == "run_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in WATCH_RUNS))
    t.upsert(row("a"))
    numbers = late._numbers()
    monkeypatch.setattr(late, "_numbers", lambda: numbers)
    t.upsert(row("b"))
    with pytest.raises(RuntimeError, match="another writer"):
        late.upsert(row("c"))
    assert sorted(r["run_id"] for r in t.read().collect()) == ["a", "b"] and len(list((tmp_path / "t").glob("d-*"))) == 2


def test_a_large_table_is_not_rewritten_for_few_changes(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), WATCH_RUNS, ["run_id"])
    rows = lambda lo, hi, v: spark.range(lo, hi, 1, 1).select(*({"run_id": F.sha2(F.col("id").cast("string"), 256), "to_version": F.lit(v)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in WATCH_RUNS))
    t.upsert(rows(0, 20_000, 0))
    whole = t.folders()[0]
    for n in range(18):
        t.upsert(rows(n, n + 2, n + 1))
    assert t.folders()[0] == whole and len(t.folders()) < 5
    assert t.read().count() == 20_000 and t.read().agg(F.sum("to_version")).first()[0] == sum(range(1, 18)) + 18 * 2


def test_stream_of_two_batches(spark, place, tmp_path):
    sink, path = place
    at = str(tmp_path / "feed")
    for rows in ([(1, "shared", "insert", 0), (2, "shared", "insert", 0), (3, "own", "insert", 0)], [(1, "shared", "delete", 1), (3, "own", "delete", 1)]):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(at)
        stream_refresh(spark.readStream.schema(FEED).parquet(at), "body", sink, str(tmp_path / "offsets"), model=MODEL, key_col="id", shadow_mode=True, ledger=loomvec.Ledger(spark, path), provider_options=OPTIONS).awaitTermination()
    assert texts_in(spark, sink) == ["shared"]


FAKE_QDRANT = """
import json, os
from types import SimpleNamespace as models_of

class models:
    VectorParams = lambda size, distance: {"size": size, "distance": distance}
    Distance = models_of(COSINE="Cosine")
    PointStruct = lambda id, vector, payload: {"id": id, "vector": vector, "payload": payload}
    PointIdsList = lambda points: points

class QdrantClient:
    def __init__(self, host, port):
        self.at = os.path.join(ROOT, host, str(port))
    def collection_exists(self, name):
        return os.path.isdir(f"{self.at}/{name}")
    def create_collection(self, name, vectors_config):
        os.makedirs(f"{self.at}/{name}")
    def upsert(self, name, points):
        for p in points:
            json.dump(p, open(f"{self.at}/{name}/{p['id']}", "w"))
    def delete(self, name, points_selector):
        for p in points_selector:
            os.remove(f"{self.at}/{name}/{p}")
    def scroll(self, name, limit, offset, with_payload, with_vectors):
        ids = sorted(i for i in os.listdir(f"{self.at}/{name}") if i >= offset)
        page = [models_of(id=i, payload={k: v for k, v in json.load(open(f"{self.at}/{name}/{i}"))["payload"].items() if k in with_payload}) for i in ids[:3]]
        return page, ids[3] if len(ids) > 3 else None
"""


def test_qdrant_behind_a_client(spark, tmp_path, monkeypatch):
    """Upsert, payload, delete, reading back in ranges of ids, and a migration, against a client that keeps points as files."""
    (tmp_path / "fake").mkdir()
    (tmp_path / "fake" / "qdrant_client.py").write_text(f"ROOT = {str(tmp_path)!r}\n{FAKE_QDRANT}")
    monkeypatch.syspath_prepend(str(tmp_path / "fake"))
    spark.sparkContext.addPyFile(str(tmp_path / "fake" / "qdrant_client.py"))
    sink = "qdrant://store:6333/docs"
    assert open_sink(sink).texts(spark).count() == 0
    texts = [f"text {k}" for k in range(40)]
    run = loomvec.embed(spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS)
    import json

    point = json.load(open(tmp_path / "store" / "6333" / "docs" / pid("text 7")))
    assert point["payload"].keys() == {"source_text", "source_hash", "embed_run_id", "created_at"} and point["payload"]["embed_run_id"] == run.run_id and len(point["vector"]) == 16
    assert texts_in(spark, sink) == sorted(texts)
    open_sink(sink).delete(spark.createDataFrame([(pid("text 7"),)], "point_id string"))
    assert len(texts_in(spark, sink)) == 39
    moved = migrate(MODEL, "openai/text-embedding-3-large", sink, shadow_mode=True, options={"openai/text-embedding-3-large": {"dim": 8}})
    assert (moved.n_source, moved.n_migrated) == (39, 39) and len(texts_in(spark, moved.sink_v2)) == 39


FAKE_POSTGRES = """
import json, os, uuid

class Cursor:
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
    def cursor(self):
        return self
    def execute(self, sql, args=None):
        json.dump([sql, args], open(f"{ROOT}/{uuid.uuid4().hex}", "w"))
    def executemany(self, sql, rows):
        json.dump([sql, [[str(x) for x in r] for r in rows]], open(f"{ROOT}/{uuid.uuid4().hex}", "w"))

def connect(uri):
    assert uri == "postgresql://me:secret@store:5432/db", uri
    return Cursor()
"""


def test_postgres_behind_a_cursor(spark, tmp_path, monkeypatch):
    """The statements of an embedding and of a refresh that deletes, with their rows."""
    import json

    for d in ("fake", "said"):
        (tmp_path / d).mkdir()
    (tmp_path / "fake" / "psycopg2.py").write_text(f"ROOT = {str(tmp_path / 'said')!r}\n{FAKE_POSTGRES}")
    monkeypatch.syspath_prepend(str(tmp_path / "fake"))
    spark.sparkContext.addPyFile(str(tmp_path / "fake" / "psycopg2.py"))
    sink = "pg://me:secret@store:5432/db?table=points"
    said = lambda what: [s for f in (tmp_path / "said").iterdir() for s in [json.loads(f.read_text())] if s[0].startswith(what)]
    loomvec.embed(spark.createDataFrame([("a",), ("b",), ("a",)], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS)
    assert len(said("CREATE")) == 1 and "vector(16)" in said("CREATE")[0][0]
    rows = [r for _, some in said("INSERT") for r in some]
    assert sorted((r[0], r[2]) for r in rows) == sorted((pid(t), t) for t in "ab") and all(r[1].count(",") == 15 for r in rows) and "ON CONFLICT" in said("INSERT")[0][0]
    feed = spark.createDataFrame([(1, "a", "insert", 0), (2, "b", "insert", 0), (1, "a", "delete", 1)], FEED)
    loomvec.watch("t", "body", sink, model=MODEL, shadow_mode=True, key_col="id", feed=feed, provider_options=OPTIONS)
    assert [i for _, (ids,) in said("DELETE") for i in ids] == [pid("a")]


def test_postgres_url_keeps_the_password_out():
    url, options = PostgresSink("pg://me:p%40ss@h:5433/db?table=t1&ssl=1").jdbc()
    assert url == "jdbc:postgresql://h:5433/db?ssl=1" and options == {"user": "me", "password": "p@ss"}


def test_keyed_table_laws(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), WATCH_RUNS, ["run_id"])
    put = lambda *rows: spark.createDataFrame(list(rows), "run_id string, to_version long").select("run_id", "to_version", *[F.lit(None).cast(f.dataType).alias(f.name) for f in WATCH_RUNS if f.name not in ("run_id", "to_version")])
    seen = lambda: sorted((r["run_id"], r["to_version"]) for r in t.read().collect())
    assert seen() == []
    t.upsert(put(("a", 1), ("b", 1)))
    t.upsert(put(("a", 2)))
    t.insert_if_absent(put(("b", 9), ("c", 3)))
    assert seen() == [("a", 2), ("b", 1), ("c", 3)]
    t.delete(put(("b", 0), ("zz", 0)))
    assert seen() == [("a", 2), ("c", 3)]
    for n in range(18):
        t.upsert(put(("a", n)))
    assert seen() == [("a", 17), ("c", 3)] and len(t.folders()) < 17


def test_latest_checkpoint_is_by_time_not_by_version(spark, place):
    from datetime import UTC, datetime

    ledger = loomvec.Ledger(spark, place[1])
    for day, version in ((1, 50), (2, 7)):
        ledger.write_watch_run(run_id=f"r{day}", timestamp=datetime(2024, 1, day, tzinfo=UTC), source_table="t", sink="s", model=MODEL, since_version=0, to_version=version)
    assert ledger.last_watch_version("t", "s") == 7 and ledger.last_watch_version("t", "other") is None


def test_names():
    assert names.parse_model("a/b/c") == names.Model("a", "b/c")
    at = names.parse_sink("qdrant://h:1/c")
    assert (at.host, at.port, at.collection) == ("h", 1, "c") and names.parse_sink("qdrant:///c").host == "localhost"
    assert names.v2_uri("pg://h/db?table=x") == "pg://h/db_v2?table=x"
    assert names.postgres_target("pg://u@h/db?table=t1&ssl=1") == ("postgresql://u@h/db?ssl=1", "t1")
    with pytest.raises(ValueError):
        names.postgres_target("pg://h/db?table=x;drop")
    assert "ON CONFLICT (id) DO NOTHING" in PostgresSink("pg://h/db").statements(3)[1]


def test_shadow_vectors_are_unit_and_stable():
    a = shadow_vector(hashlib.md5(b"x").hexdigest())
    assert len(a) == 1536 and abs(np.linalg.norm(a) - 1) < 1e-12 and (a == shadow_vector(hashlib.md5(b"x").hexdigest())).all()


def test_api_retries_only_rate_limits():
    waits, calls = [], []

    def post(url, key, body):
        calls.append(body)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "slow down", {}, None)
        return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], "usage": {"total_tokens": 5}}

    assert providers.embed_batch(["a", "b"], "m", "u", "k", post, waits.append) == ([[1.0], [2.0]], 5) and waits == [1, 2]

    def refuse(url, key, body):
        raise urllib.error.HTTPError(url, 401, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        providers.embed_batch(["a"], "m", "u", "k", refuse, waits.append)
    assert waits == [1, 2]


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")


def test_adapter_recovers_a_rotation(spark, tmp_path):
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    old = rng.normal(size=(60, 8))
    pairs = adapter.paired(vectors(spark, old), vectors(spark, old @ q), "id")
    fitted = adapter.fit(pairs)
    assert fitted.rank == 8 and np.allclose(fitted.r, q, atol=1e-5)
    fitted.save(tmp_path / "r.npy")
    assert np.allclose(adapter.Adapter.load(tmp_path / "r.npy").r, fitted.r)
    few = adapter.fit(adapter.paired(vectors(spark, old[:3]), vectors(spark, old[:3]), "id"))
    assert few.rank == 3 and np.allclose(few.r, np.eye(8), atol=1e-5)  # what is not determined stays as it is
    with pytest.raises(ValueError):
        adapter.fit(adapter.paired(vectors(spark, old), vectors(spark, old[:, :4]), "id"))
    with pytest.raises(ValueError):
        adapter.fit(pairs.limit(0))


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_nearest_equals_brute_force_with_ties(spark, monkeypatch, small):
    monkeypatch.setattr("loomvec.functions.vectors.SMALL_BASE", small)
    x = np.random.default_rng(1).normal(size=(50, 4)).round(1)
    x[10] = x[3]
    got = {}
    for r in nearest(vectors(spark, x), vectors(spark, x), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i in range(50):
        s = x @ x[i]
        want = [j for j in np.lexsort((np.arange(50), -s)) if j != i][:5]
        assert np.allclose(s[got[i]], s[want])


def test_gate(spark):
    x = np.random.default_rng(2).normal(size=(40, 6))
    assert evaluate.check(vectors(spark, x), vectors(spark, x), 5) == 1.0
    with pytest.raises(loomvec.AdapterQualityError, match="dual-write"):
        evaluate.check(vectors(spark, x), vectors(spark, x[::-1].copy()), 5)
    with pytest.raises(ValueError):
        evaluate.check(vectors(spark, x), vectors(spark, x), 40)
    with pytest.raises(ValueError):
        evaluate.check(vectors(spark, x), vectors(spark, x[:30]), 5)


def test_migrations(spark, place, tmp_path):
    sink, path = place
    ledger = loomvec.Ledger(spark, path)
    loomvec.embed(spark.createDataFrame([(f"ticket {i}",) for i in range(300)] + [("",)], "body string"), "body", MODEL, sink, shadow_mode=True, ledger=ledger, provider_options=OPTIONS)
    other = "openai/text-embedding-3-large"
    run = migrate(MODEL, other, sink, shadow_mode=True, ledger=ledger, options={other: {"dim": 8}})
    assert (run.n_source, run.n_migrated, run.n_skipped) == (301, 300, 1) and len(texts_in(spark, run.sink_v2)) == 300
    same = {MODEL: OPTIONS, other: OPTIONS}
    run = migrate(MODEL, other, sink, strategy="adapter", shadow_mode=True, ledger=ledger, adapter_dir=tmp_path, options=same)
    assert run.arr == 1.0 and run.gate_informative and adapter.Adapter.load(run.adapter_path).r.shape == (16, 16)
    run = migrate(MODEL, other, sink, strategy="shadow-eval", shadow_mode=True, ledger=ledger, options={MODEL: OPTIONS, other: {"dim": 16, "salt": 1}})
    assert 0 <= run.arr < 0.9
    assert ledger.migrate_runs.read().count() == 3
    with pytest.raises(loomvec.AdapterQualityError):
        migrate(MODEL, other, sink, strategy="adapter", shadow_mode=True, adapter_dir=tmp_path, options={MODEL: OPTIONS, other: {"dim": 16, "salt": 1}})
    with pytest.raises(ValueError):
        migrate(MODEL, other, sink, strategy="by-hand")
    empty = migrate(MODEL, other, f"file://{tmp_path}/nothing", shadow_mode=True)
    assert empty.n_source == empty.n_migrated == 0


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("a",), ("b",)], "body string").write.parquet(str(tmp_path / "t"))
    led, sink = ["--ledger", str(tmp_path / "l")], f"file://{tmp_path}/c"
    assert main([*led, "status"]) == 0 and "No runs found" in capsys.readouterr().out
    assert main([*led, "embed", "--table", str(tmp_path / "t"), "--text-col", "body", "--model", MODEL, "--sink", sink, "--shadow-mode"]) == 0
    assert "rows 2" in capsys.readouterr().out
    assert main([*led, "status", "--sink", sink]) == 0 and MODEL in capsys.readouterr().out
    assert main([*led, "migrate", "--from", MODEL, "--to", MODEL, "--sink", sink, "--shadow-mode"]) == 0 and "2 migrated" in capsys.readouterr().out
    assert main([*led, "embed", "--table", str(tmp_path / "t"), "--text-col", "body", "--model", "nameless", "--sink", sink]) == 1
    spark.createDataFrame([("a", "delete", 1)], "body string, _change_type string, _commit_version long").write.parquet(str(tmp_path / "f"))
    assert main([*led, "watch", "--table", str(tmp_path / "f"), "--text-col", "body", "--sink", sink, "--model", MODEL, "--shadow-mode"]) == 0
    assert texts_in(spark, sink) == ["b"]

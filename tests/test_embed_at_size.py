"""Whole texts are shuffled once where a batch may hold copies, and not again where it can't; many slices don't rewrite what is there."""

import random

from test_engine import MODEL, OPTIONS

import loomvec
from loomvec.plans.migrate import migrate
from loomvec.sources.sinks import open_sink


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def long_texts(n, copies=0):
    r = random.Random(7)
    texts = [f"{i} {r.randbytes(4000).hex()}" for i in range(n)]
    return texts + texts[:copies]


def test_a_rewrite_shuffles_no_texts(spark, tmp_path):
    texts = long_texts(200, copies=20)
    least = 200 * 4000  # of random digits half can be packed away
    sink, before = f"file://{tmp_path}/points", shuffled_bytes(spark)
    loomvec.embed(spark.createDataFrame([(t,) for t in texts], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS, dedup=False)
    between = shuffled_bytes(spark)
    run = migrate(MODEL, "openai/text-embedding-3-large", sink, shadow_mode=True, options={"openai/text-embedding-3-large": OPTIONS})
    after = shuffled_bytes(spark)
    assert between - before < 2.4 * least and after - between < 0.5 * least
    got = [r["source_text"] for r in open_sink(run.sink_v2).texts(spark).collect()]
    assert sorted(got) == sorted(set(texts)) and run.n_migrated == 200


def test_copies_in_a_collection_are_still_written_once(spark, tmp_path):
    """A collection of other origin, in which two points have one text."""
    sink = f"file://{tmp_path}/points"
    open_sink(sink).upsert(spark.createDataFrame([(p, None, t, None, None, None) for p, t in (("a", "x"), ("b", "x"), ("c", "y"))], "point_id string, vector array<float>, source_text string, source_hash string, embed_run_id string, created_at timestamp"))
    run = migrate(MODEL, "openai/text-embedding-3-large", sink, shadow_mode=True, options={"openai/text-embedding-3-large": OPTIONS})
    assert sorted(r["source_text"] for r in open_sink(run.sink_v2).texts(spark).collect()) == ["x", "y"] and run.n_migrated == 2


def test_many_slices_are_not_merged_on_the_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomvec.sources.keyed.COMPACT_AFTER", 2)
    sink = f"file://{tmp_path}/points"
    go = lambda texts, n: loomvec.embed(spark.createDataFrame([(t,) for t in texts], "body string"), "body", MODEL, sink, shadow_mode=True, provider_options=OPTIONS, dedup=False, slice_rows=n)
    texts = [f"text {i}" for i in range(50)]
    go(texts, 10)
    assert len(open_sink(sink).table(spark).folders()) == 5
    go(texts[:30] + ["more"], 100)  # one commit, which merges
    assert len(open_sink(sink).table(spark).folders()) <= 2
    assert sorted(r["source_text"] for r in open_sink(sink).texts(spark).collect()) == sorted([*texts, "more"])

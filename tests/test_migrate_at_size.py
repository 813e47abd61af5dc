"""Measuring two models shuffles the sample's texts, not the collection's."""

import hashlib

import loomvec
from loomvec.functions.text import text_hash
from loomvec.operators.adapter import sample_pairs
from loomvec.plans import migrate

MODEL, OTHER = "openai/text-embedding-3-small", "openai/text-embedding-3-large"


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_the_sample_is_shuffled(spark, tmp_path):
    texts = ["".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(200)) for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]], "body string")
    sink, options = f"file://{tmp_path}/points", {"dim": 4}
    loomvec.embed(rows, "body", MODEL, sink, shadow_mode=True, ledger=loomvec.Ledger(spark, tmp_path / "ledger"), provider_options=options)
    asked = []

    def vectors(sample, model):
        asked.append(sorted(r["source_hash"] for r in sample.collect()))
        return migrate.provider(migrate.parse_model(model), True)(sample, migrate.parse_model(model), 128, **options)

    before = shuffled_bytes(spark)
    run = migrate.migrate(MODEL, OTHER, sink, strategy="shadow-eval", sample=40, vectors=vectors)
    assert shuffled_bytes(spark) - before < sum(map(len, texts)) / 3
    want = sample_pairs(rows.select(text_hash("body").alias("source_hash")).distinct(), 40, "source_hash")
    assert asked == [sorted(r["source_hash"] for r in want.collect())] * 2
    assert (run.n_source, run.n_skipped, run.arr) == (300, 0, 1.0)

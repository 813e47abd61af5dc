"""Every operator and stage on odd and on empty tables: a defined result, and none lost."""

import hashlib

import pytest

import corpus_pipeline
from loomvec.llm.registry import QUERIES

ON_DOCUMENTS = ["op1_toxicity", "op2_mixing", "op3_language_id", "op4_simhash", "op5_winnowing", "op6_sharding", "op12_debruijn"]


def _scores(got, at):
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert at[1].score == at[6].score and at[2].score == at[3].score  # equal texts; null is empty


def _languages(got, at):
    assert [at[d].lang_pred for d in (2, 3, 4, 8)] == ["und"] * 4 and got[got.doc_id.isna()].lang_pred.isin(["und", "en", "fr", "de", "ja"]).all()
    assert at[1].lang_pred == at[6].lang_pred and at[1].score == at[6].score and got.score.between(0, 1).all()


def _groups(got, at):
    assert at[1].component_id == at[6].component_id == 1 and at[2].component_id == at[3].component_id == at[4].component_id == 2
    assert {at[d].fingerprint for d in (2, 3, 4)} == {"0" * 16} and at[5].component_id == at[12].component_id == 5
    assert got[got.doc_id == 7].fingerprint.nunique() == 1


def _fingerprints(got, at):
    assert at[1].fingerprint == at[6].fingerprint and at[2].fingerprint == at[3].fingerprint == at[4].fingerprint and [at[d].n_chars for d in (2, 3, 4, 9)] == [0, 0, 4, 11]
    assert at[2].edited_sha256 == hashlib.sha256(b"").hexdigest() and at[2].near_edited == 1.0 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def _shards(got, at):
    assert [at[d]["size"] for d in (2, 3, 4)] == [8, 8, 12] and (got.law == "rows").all() and got.groupby("shard").size().max() == 1 and (got.slot == 0).all() and got.shard.between(0, 23).all()


def _kept(got, at):
    assert [at[d].n_words for d in (2, 3, 4, 1)] == [0, 0, 0, 9] and at[5].n_words == 40_000 and got[got.doc_id < 5].n_removed.eq(0).all()
    assert at[12].n_words == 40_001 and at[12].n_removed == 40_000 and at[12].kept_sha256 == hashlib.sha256(b"end").hexdigest()
    assert at[5].n_removed == 40_000 - 2 * 97 * 31  # the text repeats itself after so many words


def _rates(got, at):
    assert (got.rate >= 0).all() and at[1].rate == at[6].rate


VALUES = {"op1_toxicity": _scores, "op2_mixing": _rates, "op3_language_id": _languages, "op4_simhash": _groups, "op5_winnowing": _fingerprints, "op6_sharding": _shards, "op12_debruijn": _kept}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_one_row_for_each_row(spark, odd_dir, name):
    got = QUERIES[name](spark, odd_dir).toPandas()
    assert len(got) == 16 and got.doc_id.isna().sum() == 2 and (got.doc_id == 7).sum() == 2
    assert len(set(got.columns)) == len(got.columns)
    VALUES[name](got, {d: got[got.doc_id == d].iloc[0] for d in (1, 2, 3, 4, 5, 6, 8, 9, 12)})


def test_odd_packing_and_counts(spark, odd_dir):
    got = QUERIES["op7_packing"](spark, odd_dir).toPandas()
    assert (got.piece == 0).sum() == 16 and got.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all()
    counts = QUERIES["op8_token_counts"](spark, odd_dir).toPandas()
    assert counts.n_docs.sum() == 16 and counts.context_limit.min() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty_dir, name):
    assert len(QUERIES[name](spark, empty_dir).collect()) == (1 if name == "op9_chat" else 0)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_documents(spark, odd_dir, k):
    before = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, before, odd_dir)
    if k < 4:
        assert out.columns == before.columns
    assert out.count() > 0
    assert corpus_pipeline.STAGES[k][1](spark, before.limit(0), odd_dir).count() == 0


def test_pipeline_runs_its_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        n.append(docs.count())
    assert n[0] >= n[1] > n[2] > n[3] <= n[4]
    got, want = corpus_pipeline.run(spark, sf_dir).toPandas(), corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))

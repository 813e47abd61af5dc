"""The standing index: recall against brute force, files that a search reads, and a collection that goes on changing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.operators.index import VectorIndex
from loomvec.sources.keyed import KeyedTable


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(60, 24)), 40, axis=0) + 0.5 * rng.normal(size=(2400, 24))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def rows(spark, x, ids):
    return spark.createDataFrame([(f"p{i:05d}", [float(c) for c in x[i]]) for i in ids], "point_id string, vector array<float>")


def asked(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(c) for c in x[i]]) for i in ids], "id long, vector array<float>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(int(r["point_id"][1:]))
    return out


def best(x, i, held, k=10):
    s = x[held].astype(float) @ x[i].astype(float)
    return [held[j] for j in np.lexsort((held, -s))[:k]]


@pytest.fixture
def built(spark, tmp_path, crowd):
    t = KeyedTable(spark, str(tmp_path / "points"), rows(spark, crowd, [0]).schema, ["point_id"])
    t.upsert(rows(spark, crowd, range(2000)))
    index = VectorIndex(spark, t, str(tmp_path / "index"), cells=40)
    index.refresh()
    return t, index


def test_recall_with_few_cells_read(spark, built, crowd):
    _, index = built
    queries = range(0, 2000, 40)
    got = found(index.search(asked(spark, crowd, queries), 10, probes=6))
    held = np.arange(2000)
    recall = np.mean([len(set(got[i]) & set(best(crowd, i, held))) / 10 for i in queries])
    one = index.candidates([3]).count()
    assert recall >= 0.9 and 0 < one < 400
    plan = index.candidates([3])._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]  # only their files are read
    shares = [index.candidates([r["cell"] for r in index.candidates().select("cell").distinct().limit(6).collect()]).count() / 2000]
    assert shares[0] < 0.5


def test_all_cells_are_exact(spark, built, crowd):
    _, index = built
    got = found(index.search(asked(spark, crowd, [0, 7, 1999]), 10, probes=None))
    for i in (0, 7, 1999):
        want = best(crowd, i, np.arange(2000))
        assert np.allclose(crowd[got[i]] @ crowd[i], crowd[want] @ crowd[i], atol=1e-6)


def test_the_index_follows_the_collection(spark, built, crowd, monkeypatch):
    """Points added, replaced, deleted and added again; a refresh with nothing new; a collection rewritten as a whole."""
    t, index = built
    before = len(index._state()["index"])
    index.refresh()
    assert len(index._state()["index"]) == before
    t.upsert(rows(spark, crowd, range(2000, 2400)))
    t.delete(rows(spark, crowd, range(100, 140)).select("point_id"))
    moved = rows(spark, crowd, [5]).select("point_id", F.lit([float(c) for c in -crowd[5]]).cast("array<float>").alias("vector"))
    t.upsert(moved)
    index.refresh()
    t.upsert(rows(spark, crowd, [100]))
    index.refresh()
    assert len(index._state()["index"]) == before + 2
    x = crowd.copy()
    x[5] = -x[5]
    held = np.r_[0:101, 140:2400]

    def same():
        assert index.candidates().count() == len(held) == index.candidates().select("point_id").distinct().count()
        got = found(index.search(asked(spark, x, [100, 110, 2100, 5]), 10, probes=None))
        for i in (100, 110, 2100, 5):
            assert np.allclose(x[got[i]] @ x[i], x[best(x, i, held)] @ x[i], atol=1e-6)
        assert got[5][0] == 5 and 110 not in got[110]

    same()
    monkeypatch.setattr("loomvec.sources.keyed.COMPACT_AFTER", 1)
    monkeypatch.setattr("loomvec.sources.keyed.WHOLE_SHARE", 0)
    t.upsert(rows(spark, crowd, [0]))
    index.refresh()
    assert len(index._state()["index"]) == 1
    same()


def test_full_cells_are_sliced(spark, built, crowd, monkeypatch):
    monkeypatch.setattr("loomvec.operators.index.BASE_BLOCK", 20)
    t, index = built
    t.upsert(rows(spark, crowd, [0]))
    index.refresh()
    assert max(index._state()["slices"].values()) > 2
    got = found(index.search(asked(spark, crowd, [1, 2]), 10, probes=None))
    for i in (1, 2):
        assert np.allclose(crowd[got[i]] @ crowd[i], crowd[best(crowd, i, np.arange(2000))] @ crowd[i], atol=1e-6)


def test_nothing_indexed(spark, tmp_path, crowd):
    t = KeyedTable(spark, str(tmp_path / "points"), rows(spark, crowd, [0]).schema, ["point_id"])
    index = VectorIndex(spark, t, str(tmp_path / "index"))
    index.refresh()
    with pytest.raises(ValueError, match="refresh"):
        index.search(asked(spark, crowd, [0]), 3)

"""Affine, low-rank and chained adapters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.operators import adapter, evaluate, residual
from loomvec.operators.chain import AdapterBook


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, vector array<double>")


def pairs(spark, old, new):
    return adapter.paired(vectors(spark, old), vectors(spark, new), "id")


@pytest.fixture(scope="module")
def spaces():
    rng = np.random.default_rng(5)
    new = rng.normal(size=(300, 7)) * [3, 1, 1, 0.5, 1, 2, 1] + rng.normal(size=7)
    old = new @ rng.normal(size=(7, 5)) + rng.normal(size=5) + 0.3 * rng.normal(size=(300, 5))
    return old, new


def test_affine_is_least_squares_between_unequal_dimensions(spark, spaces):
    old, new = spaces
    got = adapter.fit_affine(pairs(spark, old, new), ridge=0.0)
    want, *_ = np.linalg.lstsq(np.c_[new, np.ones(len(new))], old, rcond=None)
    assert np.allclose(got.a, want[:7].T) and np.allclose(got.b, want[7]) and got.rank == 5
    left = old - new @ got.a.T - got.b
    assert np.isclose(got.error, np.sqrt((left**2).sum(axis=1).mean()))


@pytest.mark.parametrize("rank", [1, 2, 4, 9])
def test_low_rank_leaves_the_least_that_its_rank_can(spark, spaces, rank):
    """The best map of a rank is the full one, projected onto the directions in which its values vary most."""
    old, new = spaces
    got = adapter.fit_affine(pairs(spark, old, new), rank=rank, ridge=0.0)
    full, *_ = np.linalg.lstsq(new - new.mean(0), old - old.mean(0), rcond=None)
    _, _, vt = np.linalg.svd((new - new.mean(0)) @ full, full_matrices=False)
    best = full @ vt[:rank].T @ vt[:rank]
    assert np.linalg.matrix_rank(got.a) == got.rank == min(rank, 5) and np.allclose(got.a, best.T)


def test_affine_where_pairs_leave_directions_open(spark):
    rng = np.random.default_rng(6)
    new = rng.normal(size=(4, 6))
    got = adapter.fit_affine(pairs(spark, new[:, :3] * 2 + 1, new), ridge=0.0)
    assert np.isfinite(got.a).all() and np.allclose(new @ got.a.T + got.b, new[:, :3] * 2 + 1) and got.error < 1e-6
    one = adapter.fit_affine(pairs(spark, [[1.0, 2.0]] * 3, [[5.0, 5.0]] * 3))
    assert np.allclose(one.b, [1, 2]) and np.allclose(one.a, 0)
    for bad in (lambda: adapter.fit_affine(pairs(spark, new, new).limit(0)), lambda: adapter.fit_affine(pairs(spark, new, new), rank=0), lambda: adapter.fit_affine(pairs(spark, new, new).union(pairs(spark, new[:, :2], new)))):
        with pytest.raises(ValueError):
            bad()


def test_affine_is_applied_where_the_vectors_are(spark, spaces):
    old, new = spaces
    got = adapter.fit_affine(pairs(spark, old, new))
    rows = adapter.predict(vectors(spark, new), got.a, offset=got.b).orderBy("id").collect()
    assert np.allclose([r["adapted"] for r in rows], new @ got.a.T + got.b, atol=1e-4)
    with pytest.raises(Exception, match="7 components, not of \\[5\\]"):
        adapter.predict(vectors(spark, old), got.a).collect()


def test_chains_take_the_cheapest_path_and_bound_its_error(spark, tmp_path):
    rng = np.random.default_rng(7)
    truth = {"a": rng.normal(size=(200, 4))}
    for name, before, noise in (("b", "a", 0.01), ("c", "b", 0.02), ("d", "c", 0.03)):
        truth[name] = truth[before] @ np.linalg.qr(rng.normal(size=(4, 4)))[0] + noise * rng.normal(size=(200, 4))
    book = AdapterBook(spark, str(tmp_path / "book"))
    for to, start in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("b", "a")):
        book.put(start, to, adapter.fit_affine(pairs(spark, truth[to], truth[start])))
    book.put("d", "a", adapter.fit_affine(pairs(spark, truth["a"], truth["d"]), rank=1))
    routes = {r["to_model"]: (r["route"], r["error"]) for r in book.routes("d").collect()}
    assert {k: r for k, (r, _) in routes.items()} == {"a": list("dcba"), "b": list("dcb"), "c": list("dc")}
    route, whole = book.chained("d", "a")
    steps = [book.get(*s) for s in zip(route, route[1:])]
    assert np.allclose(whole.a, steps[2].a @ steps[1].a @ steps[0].a) and np.isclose(whole.error, routes["a"][1])
    left = np.sqrt(((truth["a"] - truth["d"] @ whole.a.T - whole.b) ** 2).sum(axis=1).mean())
    assert left <= whole.error < book.get("d", "a").error
    book.put("d", "a", adapter.fit_affine(pairs(spark, truth["a"], truth["d"])))  # a better one takes its place
    assert book.chained("d", "a")[0] == ["d", "a"]
    with pytest.raises(ValueError, match="no chain"):
        book.chained("a", "nowhere")
    with pytest.raises(ValueError, match="can't be followed"):
        steps[0].after(adapter.Affine(np.eye(3), np.zeros(3), 3, 0.0))


@pytest.fixture(scope="module")
def bent(spark):
    """Old vectors that bend with the new ones: unit vectors on both sides."""
    rng = np.random.default_rng(9)
    new = rng.normal(size=(400, 6))
    old = np.c_[new, np.abs(new[:, :3]) * 2]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit(old), unit(new)


def test_a_network_finds_neighbours_that_no_linear_map_does(spark, bent):
    old, new = bent
    rows = pairs(spark, old, new)
    net = residual.fit_residual(rows, rounds=6, steps=60, tasks=3)
    again = residual.fit_residual(rows.repartition(5), rounds=6, steps=60, tasks=3, affine=net.affine)
    assert all((a == b).all() for a, b in zip(net.weights, again.weights)) and net.losses == again.losses  # to the last bit
    assert np.isclose(net.losses[0], net.affine.error**2) and net.losses[-1] < 0.5 * net.losses[0]
    from loomvec.operators.evaluate import adapted_recall

    recall = lambda df: adapted_recall(vectors(spark, old), df.select("id", F.col("adapted").alias("vector")), 5).first()["arr"]
    bare = recall(adapter.predict(vectors(spark, new), net.affine.a, offset=net.affine.b))
    assert recall(residual.predict_residual(vectors(spark, new), net)) > bare + 0.1


def test_a_lost_task_begins_the_stage_again(spark, bent, tmp_path, monkeypatch):
    old, new = bent
    mark, step = str(tmp_path / "failed"), residual._gradient

    def once(*of):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("a task is lost")
        return step(*of)

    affine = adapter.fit_affine(pairs(spark, old, new))
    want = residual.fit_residual(pairs(spark, old, new), rounds=1, steps=3, tasks=2, affine=affine)
    monkeypatch.setattr(residual, "_gradient", once)
    import pyspark.cloudpickle as inner

    inner.register_pickle_by_value(residual)
    try:
        got = residual.fit_residual(pairs(spark, old, new), rounds=1, steps=3, tasks=2, affine=affine)
    finally:
        inner.unregister_pickle_by_value(residual)
    assert (tmp_path / "failed").exists() and all((a == b).all() for a, b in zip(got.weights, want.weights))


# Split traffic


def test_arms_are_sticky_and_grow(spark):
    ids = spark.range(5000)
    arms = {share: {r["id"] for r in evaluate.assigned(ids, share).where("arm = 'new'").collect()} for share in (0.0, 0.2, 0.5, 1.0)}
    assert arms[0.0] == set() and arms[0.2] < arms[0.5] < arms[1.0] == set(range(5000)) and abs(len(arms[0.2]) - 1000) < 120


def test_the_interval_holds_the_difference(spark):
    """Bernoulli hits of 0.8 and 0.6: the interval is about as wide as theory says, and its middle is the sample's difference."""
    rng = np.random.default_rng(3)
    rows = [(i, "old" if i % 3 else "new", float(rng.random() < (0.8 if i % 3 else 0.6))) for i in range(900)]
    got = evaluate.split_delta(spark.createDataFrame(rows, "query_id long, arm string, recall double")).first()
    old, new = ([r for _, a, r in rows if a == arm] for arm in ("old", "new"))
    assert (got["n_old"], got["n_new"]) == (600, 300) and np.isclose(got["delta"], np.mean(new) - np.mean(old))
    width = 2 * 1.96 * np.sqrt(np.var(old) / 600 + np.var(new) / 300)
    assert got["delta_low"] < got["delta"] < got["delta_high"] and 0.75 * width < got["delta_high"] - got["delta_low"] < 1.25 * width
    alone = evaluate.split_delta(spark.createDataFrame(rows[1:3], "query_id long, arm string, recall double")).first()
    assert (alone["n_old"], alone["n_new"], alone["delta"]) == (2, 0, None)


def test_poisson_counts(spark):
    u = [0.0, 0.36, 0.37, 0.7357, 0.736, 0.9196, 0.9197, 0.99999, 1 - 1e-12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(evaluate.poisson(F.col("u"))).collect()]
    assert got[:7] == [0, 0, 1, 1, 2, 2, 3] and got[7] >= 6 and got[8] >= 12

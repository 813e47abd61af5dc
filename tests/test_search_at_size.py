"""Exact search shuffles vectors once, not once for every block they meet, and finds what all pairs find."""

import numpy as np

from loomvec.functions import vectors as v


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "id long, vector array<double>")


def small_pieces(monkeypatch):
    for name, n in {"SMALL_BASE": 0, "BASE_BLOCK": 16, "QUERY_CHUNK": 16, "PACK": 16}.items():
        monkeypatch.setattr(v, name, n, raising=False)


def test_what_is_shuffled_grows_with_the_vectors(spark, monkeypatch):
    small_pieces(monkeypatch)
    x = np.random.default_rng(3).normal(size=(1600, 4))
    written = []
    for n in (400, 1600):
        rows, before = table(spark, x[:n]).coalesce(2), shuffled_rows(spark)
        assert v.nearest(rows, rows, 2).count() == 2 * n
        written.append(shuffled_rows(spark) - before)
    assert written[1] <= 4.5 * written[0] and written[1] <= 6 * 1600


def test_pieces_find_what_all_pairs_find(spark, monkeypatch):
    """Equal vectors over many pieces, a vector that isn't finite, fewer vectors than asked for, queries from elsewhere."""
    small_pieces(monkeypatch)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(300, 4)).astype(float)
    x[7, 0] = np.nan
    q = rng.integers(-2, 3, size=(90, 4)).astype(float)
    for asked, ids, same, k in ((x, np.arange(300), True, 12), (q, np.arange(1000, 1090), False, 12), (q[:3], np.arange(3), False, 400)):
        got = {}
        for r in v.nearest(table(spark, asked, ids), table(spark, x), k, exclude_same_id=same).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for i, a in zip(ids.tolist(), asked, strict=True):
            s = x @ a
            near = [j for j in np.lexsort((np.arange(300), -s)).tolist() if not np.isnan(s[j]) and not (same and j == i)][:k]
            assert got.get(i, []) == [(n + 1, j) for n, j in enumerate(near)]

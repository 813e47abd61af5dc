"""Vector arithmetic: column expressions for single rows, numpy in Arrow batches for searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.plans.session import materialised

#: Base vectors of a block, and queries of a chunk, that meet in one task.
BASE_BLOCK, QUERY_CHUNK = 16_384, 4_096
#: Vectors packed into one row, and components at most (4 MB of doubles).
PACK, PACK_COMPONENTS = 4_096, 1 << 19
#: A base of at most so many vector components (8 MB of doubles) goes to every task whole, and nothing is shuffled.
SMALL_BASE = 1 << 20
SHADOW_DIM = 1536


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def shadow_vector(hash_: str, dim: int = SHADOW_DIM, salt: int = 0) -> np.ndarray:
    """Deterministic unit vector of a text hash: the generator is seeded by its first 8 hexadecimal digits (and a salt)."""
    seed = [int(hash_[:8], 16)] if not salt else [int(hash_[:8], 16), salt]
    v = -1.0 + 2.0 * np.random.RandomState(seed).random_sample(dim)
    return v / np.sqrt(np.dot(v, v))


def with_shadow_vectors(df: DataFrame, dim: int = SHADOW_DIM, salt: int = 0, hash_col: str = "source_hash") -> DataFrame:
    """``df`` with ``vector``, one shadow vector for each row's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                flat = np.array([shadow_vector(h, dim, salt) for h in b.column(hash_col).to_pylist()], np.float32).reshape(-1)
                vector = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns, vector], names=[*b.schema.names, "vector"])

    schema = df.select("*", F.array(F.lit(0.0).cast("float")).alias("vector")).schema
    return df.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _best(queries: pa.RecordBatch, ids: np.ndarray, vecs: np.ndarray, k: int, exclude_same_id: bool) -> dict[str, pa.Array]:
    """The best ``k`` of ``vecs`` for each of ``queries``, best first."""
    qids, sims = queries.column("id").to_numpy(), _matrix(queries.column("vector")) @ vecs.T
    if exclude_same_id:
        sims[qids[:, None] == ids[None, :]] = -np.inf
    edges = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(sims), -np.inf)
    tops = []
    for row, edge in zip(sims, edges, strict=True):
        top = np.flatnonzero((row >= edge) & (row > -np.inf))  # with all ties of the last
        tops.append(top[np.lexsort((ids[top], -row[top]))[:k]])
    sizes = [len(top) for top in tops]
    row, at = np.repeat(np.arange(len(tops)), sizes), np.concatenate(tops)
    rank = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return {"query_id": pa.array(qids[row]), "rank": pa.array(rank, pa.int32()), "id": pa.array(ids[at]), "score": pa.array(sims[row, at])}


def _nearest_of_few(queries: DataFrame, base: DataFrame, k: int, exclude_same_id: bool) -> DataFrame:
    """``nearest`` where the whole base, at most SMALL_BASE components, goes to every task."""
    whole = base.toArrow()
    held = base.sparkSession.sparkContext.broadcast((whole.column("id").to_numpy(), _matrix(whole.column("vector").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield pa.RecordBatch.from_pydict(_best(b.slice(at, 256), *held.value, k, exclude_same_id))

    return queries.mapInArrow(run, "query_id long, rank int, id long, score double")


def nearest(queries: DataFrame, base: DataFrame, k: int, exclude_same_id: bool = True) -> DataFrame:
    """(query_id, rank, id, score): the exact ``k`` nearest of ``base`` (id, vector) by inner product for each of ``queries`` (id, vector).

    Queries are dealt once, some QUERY_CHUNK to a task; the base is packed into matrices and written once, and every task reads through it, block by block, holding
    only its queries' best ``k`` so far. So nothing grows with the number of pairs but arithmetic and reading: shuffled and written are each vector once, and ``k`` rows for a
    query (for few queries a small number of times that, as the base is then divided between tasks). A small base isn't written but goes to every task.
    Ties go to the smaller id.
    """
    base, queries = (x.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")) for x in (base, queries))
    held = base.agg(F.count("*").alias("rows"), F.sum(F.size("vector")).alias("components")).first()
    if 0 < held["rows"] and held["components"] <= SMALL_BASE:
        return _nearest_of_few(queries, base, k, exclude_same_id)
    size = max(1, min(PACK, PACK_COMPONENTS * held["rows"] // max(1, held["components"] or 0)))
    chunks, cores = max(1, -(-queries.count() // QUERY_CHUNK)), base.sparkSession.sparkContext.defaultParallelism
    blocks = materialised(_packed(base.coalesce(max(cores, -(-held["rows"] // PACK))), size).toDF("ids", "vectors"))
    asked = _packed(queries.repartition(chunks, "id"), size).toDF("query_ids", "queries").withColumn("chunk", F.monotonically_increasing_id())
    # the left side passes by in pieces, the right one's part, a few packed rows, is held; with few chunks the base is divided, so that all cores have work
    pairs = blocks.coalesce(-(-2 * cores // chunks)).hint("shuffle_replicate_nl").crossJoin(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by chunk: its queries' ids, and scores and ids of what is nearest so far
        for b in batches:
            for at in range(b.num_rows):
                ids, vecs, qids, asks, chunk = (b.column(c)[at] for c in ("ids", "vectors", "query_ids", "queries", "chunk"))
                ids, qids = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(qids.as_buffer(), np.int64)
                vecs, asks = np.frombuffer(vecs.as_buffer()).reshape(len(ids), -1), np.frombuffer(asks.as_buffer()).reshape(len(qids), -1)
                if chunk.as_py() not in best:
                    best[chunk.as_py()] = (qids.copy(), np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), np.int64))
                _improve(*best[chunk.as_py()], asks, ids, vecs, exclude_same_id)
        for qids, scores, found in best.values():
            there = scores > -np.inf
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(qids, there.sum(axis=1))), "id": pa.array(found[there]), "score": pa.array(scores[there])})

    return _ranked(pairs.mapInArrow(run, "query_id long, id long, score double"), k)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Up to ``size`` of ``rows`` (id, vector) in one: their ids and their vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, n = [], [], 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                b = whole.slice(at, size - n)
                at, n = at + b.num_rows, n + b.num_rows
                ids.append(b.column("id").to_numpy().tobytes())
                vecs.append(_matrix(b.column("vector")).tobytes())
                if n == size:
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([b"".join(ids)], pa.binary()), "vectors": pa.array([b"".join(vecs)], pa.binary())})
                    ids, vecs, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([b"".join(ids)], pa.binary()), "vectors": pa.array([b"".join(vecs)], pa.binary())})

    return rows.mapInArrow(run, "ids binary, vectors binary")


def _improve(qids: np.ndarray, scores: np.ndarray, found: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, exclude_same_id: bool) -> None:
    """Put what is nearer of ``vecs`` into ``scores`` and ``found`` (a row for each query, best first, -inf where there is nothing yet)."""
    k = scores.shape[1]
    odd = not (np.isfinite(vecs).all() and np.isfinite(queries).all())
    for at in range(0, len(qids), 256):
        part = slice(at, at + 256)
        sims = queries[part] @ vecs.T
        if exclude_same_id:
            sims[qids[part, None] == ids[None, :]] = -np.inf
        if odd:
            sims[np.isnan(sims)] = -np.inf
        edge = scores[part, -1]
        if (edge == -np.inf).any() and len(ids) > k:
            edge = np.maximum(edge, np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k])
        row, col = np.divmod(np.flatnonzero((sims >= edge[:, None]).reshape(-1)), len(ids))  # with all ties of the last
        if not len(row):
            continue
        of = np.concatenate([np.repeat(np.arange(len(sims)), k), row])
        score, which = np.concatenate([scores[part].reshape(-1), sims[row, col]]), np.concatenate([found[part].reshape(-1), ids[col]])
        order = np.lexsort((which, -score, of))
        of = of[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
        scores[part], found[part] = score[order].reshape(-1, k), which[order].reshape(-1, k)


def meet(base: DataFrame, queries: DataFrame, k: int, exclude_same_id: bool) -> DataFrame:
    """The best ``k`` over all meetings of base vectors and queries (both: probe, 0 or 1, block, chunk, id, vector) of one block and chunk.

    A task holds the base vectors of one block at a time, and any number of queries pass by.
    """
    rows = base.unionByName(queries).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs = None, np.zeros(0, np.int64), None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("block", "chunk", "probe")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                part, own = whole.slice(lo, hi - lo), tuple(keys[lo, :2])
                if own != key:
                    key, ids, vecs = own, np.zeros(0, np.int64), None
                if not keys[lo, 2]:
                    new = _matrix(part.column("vector"))
                    vecs = new if vecs is None else np.concatenate([vecs, new])
                    ids = np.concatenate([ids, part.column("id").to_numpy()])
                    continue
                if vecs is None:
                    continue
                for at in range(0, part.num_rows, 256):
                    yield pa.RecordBatch.from_pydict(_best(part.slice(at, 256), ids, vecs, k, exclude_same_id))

    return _ranked(rows.mapInArrow(run, "query_id long, rank int, id long, score double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query's finds, with their ranks."""
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))

"""Adapters between two vector spaces: distributed sums of products, small decompositions on the driver, distributed application.

``fit`` finds the nearest rotation; ``fit_affine`` any linear map and an offset, of full or of bounded rank, also between unequal dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, old, new): two tables' vectors of the same key; order plays no part."""
    return old.select(key, F.col("vector").alias("old")).join(new.select(key, F.col("vector").alias("new")), key)


def sample_pairs(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same ones every time."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def _flat(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def df_cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def cross_covariance_rows(pairs: DataFrame) -> DataFrame:
    """(i, row): the sums over pairs of old[i] * new[j], a row of doubles for each i.

    There is one partial matrix for each core, not for each piece of the input, and they are summed by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (_flat(b.column(n), len(b.column(n)[0])) for n in ("old", "new"))
            total = a.T @ c if total is None else total + a.T @ c
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total))), "row": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), b.column("row").to_pylist(), strict=True):
                part = np.frombuffer(row)
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(sums), pa.int64()), "row": pa.array([r.tobytes() for r in sums.values()], pa.binary())})

    vectors = pairs.select(F.col("old").cast("array<double>").alias("old"), F.col("new").cast("array<double>").alias("new"))
    return vectors.coalesce(df_cores(pairs)).mapInArrow(run, "i long, row binary").repartition("i").mapInArrow(add, "i long, row binary")


def cross_covariance(pairs: DataFrame) -> DataFrame:
    """``cross_covariance_rows`` cell by cell: (i, j, v)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), b.column("row").to_pylist(), strict=True):
                v = np.frombuffer(row)
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(v), i)), "j": pa.array(np.arange(len(v))), "v": pa.array(v)})

    return cross_covariance_rows(pairs).mapInArrow(cells, "i long, j long, v double")


@dataclass
class Adapter:
    """``r`` maps a new-space row vector x to old space as x r^T; ``rank`` is how many directions the pairs determined."""

    r: np.ndarray
    rank: int

    def save(self, path: str | Path) -> None:
        np.save(path, self.r)

    @classmethod
    def load(cls, path: str | Path) -> Adapter:
        r = np.load(path)
        return cls(r, len(r))


def procrustes(m: np.ndarray) -> Adapter:
    """The orthogonal matrix nearest to a cross-covariance. Directions that the pairs leave open are mapped to each other as nearly as identity allows."""
    u, s, vt = np.linalg.svd(m)
    rank = int((s > s.max(initial=0.0) * len(m) * np.finfo(float).eps).sum())
    r = u[:, :rank] @ vt[:rank]
    if rank < len(m):
        left, right = u[:, rank:], vt[rank:].T
        a, _, b = np.linalg.svd(left.T @ right)
        r = r + left @ (a @ b) @ right.T
    return Adapter(r.astype(np.float32), rank)


def fit(pairs: DataFrame) -> Adapter:
    """Least-squares rotation from new to old space: minimises the distance between old and new r^T."""
    dims = pairs.agg(F.min(F.size("old")).alias("a"), F.max(F.size("old")).alias("b"), F.min(F.size("new")).alias("c"), F.max(F.size("new")).alias("d")).first()
    if dims["a"] is None:
        raise ValueError("no pairs to fit an adapter to")
    if len(set(dims)) != 1:
        raise ValueError(f"the spaces must have one dimension, not {sorted(set(dims))}; use the dual-write strategy")
    m = np.zeros((dims["a"], dims["a"]))
    for r in cross_covariance_rows(pairs).collect():  # as many rows as dimensions, whatever the input
        m[r["i"]] = np.frombuffer(r["row"])
    return procrustes(m)


@dataclass
class Affine:
    """Maps a new-space row vector x to x a^T + b. ``error``: root mean square of what is left over the pairs it was fitted to; ``gain``: by how much it can stretch a vector."""

    a: np.ndarray
    b: np.ndarray
    rank: int
    error: float

    @property
    def gain(self) -> float:
        return float(np.linalg.norm(self.a, 2))

    def after(self, first: Affine) -> Affine:
        """``first``, then this. The error is a bound: this one stretches what the first has left, and adds its own."""
        if first.a.shape[0] != self.a.shape[1]:
            raise ValueError(f"a map to {first.a.shape[0]} dimensions can't be followed by one from {self.a.shape[1]}")
        return Affine(self.a @ first.a, self.a @ first.b + self.b, min(self.rank, first.rank), self.gain * first.error + self.error)


def moments(pairs: DataFrame) -> tuple[int, int, np.ndarray]:
    """Dimensions of new and old, and the sums over pairs of (new, 1)[i] * (new, 1, old)[j]: all that least squares asks of the pairs."""
    dims = pairs.agg(F.min(F.size("old")).alias("a"), F.max(F.size("old")).alias("b"), F.min(F.size("new")).alias("c"), F.max(F.size("new")).alias("d")).first()
    if dims["a"] is None:
        raise ValueError("no pairs to fit an adapter to")
    if dims["a"] != dims["b"] or dims["c"] != dims["d"]:
        raise ValueError(f"all vectors of a space must have one dimension, not {dims['a']} to {dims['b']} and {dims['c']} to {dims['d']}")
    n_new, n_old, one = dims["c"], dims["a"], F.array(F.lit(1.0))
    new, old = F.col("new").cast("array<double>"), F.col("old").cast("array<double>")
    out = np.zeros((n_new + 1, n_new + 1 + n_old))
    for r in cross_covariance_rows(pairs.select(F.concat(new, one).alias("old"), F.concat(new, one, old).alias("new"))).collect():  # as many rows as dimensions, whatever the input
        out[r["i"]] = np.frombuffer(r["row"])
    return n_new, n_old, out


def reduced_rank(m: np.ndarray, n_new: int, squares: float, rank: int | None, ridge: float) -> Affine:
    """The map of at most ``rank`` that leaves the least squares, from ``moments`` and the sum of all squares of old components.

    With means taken off, the new vectors are whitened; the cross moment's largest singular directions then are those that explain most of the old ones.
    ``ridge`` is added to the new components' variances, as a share of their mean.
    """
    n = m[n_new, n_new]
    mean_new, mean_old = m[n_new, :n_new] / n, m[n_new, n_new + 1 :] / n
    within = m[:n_new, :n_new] / n - np.outer(mean_new, mean_new)
    across = m[:n_new, n_new + 1 :] / n - np.outer(mean_new, mean_old)
    w, v = np.linalg.eigh(within + ridge * np.trace(within) / n_new * np.eye(n_new))
    keep = w > w.max(initial=0.0) * n_new * np.finfo(float).eps
    white = v[:, keep] / np.sqrt(w[keep])
    left, s, right = np.linalg.svd(white.T @ across, full_matrices=False)
    held = min(len(s) if rank is None else rank, int((s > s.max(initial=0.0) * n_new * np.finfo(float).eps).sum()))
    a = ((white @ left[:, :held]) * s[:held]) @ right[:held]
    total = squares / n - mean_old @ mean_old
    error = total - 2 * np.sum(a * across) + np.sum(a * (within @ a))
    return Affine(a.T, mean_old - mean_new @ a, held, float(np.sqrt(max(error, 0.0))))


def fit_affine(pairs: DataFrame, rank: int | None = None, ridge: float = 1e-9) -> Affine:
    """Least-squares map with offset from new to old space, of rank at most ``rank``; the dimensions may differ. Pairs are read once for their moments."""
    if rank is not None and rank < 1:
        raise ValueError(f"a rank of {rank} maps nothing")
    n_new, _, m = moments(pairs)
    squares = pairs.agg(F.sum(F.aggregate(F.col("old").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)).alias("s")).first()["s"]
    return reduced_rank(m, n_new, squares, rank, ridge)


def predict(df: DataFrame, r: np.ndarray, vector: str = "vector", out: str = "adapted", offset: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``out`` = vector r^T (+ ``offset``). Vectors of another dimension than the map's are refused by name."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(r, np.float64).T.copy())  # dimension squared, whatever the input
    add = 0.0 if offset is None else np.asarray(offset, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sizes = set(pa.compute.list_value_length(b.column(vector)).unique().to_pylist()) - {len(shared.value)}
                if sizes:
                    raise ValueError(f"the adapter maps vectors of {len(shared.value)} components, not of {sorted(sizes, key=str)}")
                x = _flat(b.column(vector), len(shared.value)) @ shared.value + add
                flat = pa.array(x.astype(np.float32).reshape(-1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)], names=[*b.schema.names, out])

    return df.mapInArrow(run, df.select("*", F.array(F.lit(0.0).cast("float")).alias(out)).schema)

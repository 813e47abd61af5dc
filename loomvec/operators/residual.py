"""A small network on top of an affine adapter, for what no linear map explains.

new x maps to A x + b + V tanh(W s + c) + d, s being x with unit variance. The pairs stay dealt over barrier tasks, each with its own part in memory. In a round every task
makes some steps on its own pairs; then all of them get all weights, which they average in the order of the tasks' numbers, by their numbers of pairs. An exchange takes about a
second, so gradients aren't exchanged at every step. All tasks end with the same network, two runs on the same affine map agree to the last bit, and if a task is lost the stage begins
again. Nothing but the finished network reaches the driver.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.operators.adapter import Affine, _flat, fit_affine

#: Of Adam, a published method: its decay rates and the number that keeps it from dividing by zero.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8


@dataclass
class Residual:
    affine: Affine
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    losses: list[float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        w, c, v, d = self.weights
        return x @ self.affine.a.T + self.affine.b + np.tanh((x - self.mean) / self.scale @ w + c) @ v + d


def _gradient(weights: list[np.ndarray], s: np.ndarray, left: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum of squares that a network leaves of ``left``, and its gradient."""
    w, c, v, d = weights
    h = np.tanh(s @ w + c)
    gap = h @ v + d - left
    back = gap @ v.T * (1 - h * h)
    return float((gap * gap).sum()), [2 * s.T @ back, 2 * back.sum(axis=0), 2 * h.T @ gap, 2 * gap.sum(axis=0)]


def fit_residual(pairs: DataFrame, key: str = "id", hidden: int = 64, rounds: int = 10, steps: int = 30, tasks: int = 4, rate: float = 0.02, decay: float = 1e-4, seed: int = 0, affine: Affine | None = None) -> Residual:
    """Learn from ``pairs`` (key, old, new), of which each of ``tasks`` holds its part in memory: a sample, as for any adapter.

    ``steps`` are those of a round. ``tasks`` must run at once, so they are at most as many as there are cores. ``losses`` has the mean squares left before each round and after the last.
    """
    affine = affine or fit_affine(pairs)
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    rows = pairs.select(F.col(key).alias("key"), F.col("old").cast("array<double>").alias("old"), F.col("new").cast("array<double>").alias("new"))
    rows = rows.repartition(min(tasks, cores), F.xxhash64("key")).sortWithinPartitions("key")
    a, b = affine.a, affine.b

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        held = [(_flat(x.column("old"), len(b)), _flat(x.column("new"), a.shape[1])) for x in batches if x.num_rows]
        old = np.concatenate([o for o, _ in held]) if held else np.zeros((0, len(b)))
        new = np.concatenate([n for _, n in held]) if held else np.zeros((0, a.shape[1]))

        def summed(mine: list[np.ndarray]) -> list[np.ndarray]:
            flat = np.concatenate([np.ravel(m) for m in mine])
            told = context.allGather(base64.b64encode(flat.tobytes()).decode())
            total = np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0)
            return [p.reshape(np.shape(m)) for p, m in zip(np.split(total, np.cumsum([np.size(m) for m in mine])[:-1]), mine)]

        n, sums, squares = summed([np.array([len(new)], float), new.sum(axis=0), (new * new).sum(axis=0)])
        mean = sums / n
        scale = np.sqrt(np.maximum(squares / n - mean * mean, TINY))
        s, left = (new - mean) / scale, old - new @ a.T - b
        rng = np.random.default_rng(seed)
        weights = [rng.normal(size=(a.shape[1], hidden)) / np.sqrt(a.shape[1]), np.zeros(hidden), np.zeros((hidden, len(b))), np.zeros(len(b))]
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        losses = []
        for done in range(rounds + 1):
            loss, _ = _gradient(weights, s, left)
            for step in range(done * steps + 1, (done + 1) * steps + 1) if done < rounds and len(s) else ():
                for k, g in enumerate(_gradient(weights, s, left)[1]):
                    g = g / len(s) + decay * weights[k]
                    first[k], second[k] = FIRST * first[k] + (1 - FIRST) * g, SECOND * second[k] + (1 - SECOND) * g * g
                    pace = rate * min(1.0, 4 * (1 - step / (rounds * steps + 1)))  # slower in the last quarter
                    weights[k] = weights[k] - pace * (first[k] / (1 - FIRST**step)) / (np.sqrt(second[k] / (1 - SECOND**step)) + TINY)
            got = summed([np.array([loss]), *(len(s) * x for x in (*weights, *first, *second))])
            losses.append(float(got[0][0] / n[0]))
            weights, first, second = (list(x) for x in ([g / n[0] for g in got[1 + 4 * j : 5 + 4 * j]] for j in range(3)))
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps((mean, scale, weights, losses))], pa.binary())})

    # the shuffle of one row makes training a stage that can begin again: a barrier stage that ends a job can't
    net = rows.mapInArrow(train, "net binary", barrier=True).repartition(1).collect()
    return Residual(affine, *pickle.loads(bytes(net[0]["net"])))


def predict_residual(df: DataFrame, net: Residual, vector: str = "vector", out: str = "adapted") -> DataFrame:
    """``df`` with ``out``: ``vector`` as the network maps it."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # its size is that of the two dimensions times the hidden units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                y = shared.value.apply(_flat(b.column(vector), shared.value.affine.a.shape[1])).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.reshape(-1)))], names=[*b.schema.names, out])

    return df.mapInArrow(run, df.select("*", F.array(F.lit(0.0).cast("float")).alias(out)).schema)

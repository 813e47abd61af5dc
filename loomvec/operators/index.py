"""A standing index of a collection: vectors stored by the cell of their nearest centre, so that a search reads only some cells.

Centres are found by k-means over a bounded sample, in distributed rounds; every vector of the collection is indexed. The index follows the collection's commits: a refresh reads only
the folders that are new since the last one and adds their vectors; what they replace or delete is told by a table of changed points, which a search consults. When
the collection has been rewritten as a whole, so is the index. Searching all cells is exact.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions.vectors import BASE_BLOCK, QUERY_CHUNK, _matrix, meet, nearest
from loomvec.plans.session import materialised
from loomvec.sources.keyed import KeyedTable

#: Vectors that centres are found from, centres at most (so they can go to every task), and rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS = 50_000, 4096, 8


def _cells(df: DataFrame, centres, column: str, n: int) -> DataFrame:
    """``df`` with ``cells``: the ``n`` centres of largest inner product with the vector, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                best = np.argsort(-(_matrix(b.column(column)) @ centres.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32()), pa.array(best.reshape(-1)))], names=[*b.schema.names, "cells"])

    return df.mapInArrow(run, df.select("*", F.array(F.lit(0)).alias("cells")).schema)


def centres_of(vectors: DataFrame, key: str, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """``cells`` unit centres of ``vectors`` (key, vector): those of a sample in hash order, moved to the means of what is nearest to them. Equal vectors are one."""
    sc = vectors.sparkSession.sparkContext
    some = vectors.select(F.md5(F.col(key).cast("string")).alias("h"), F.col("vector").cast("array<double>").alias("vector")).orderBy("h").limit(sample)
    some = materialised(some)
    first = np.array([r["vector"] for r in some.dropDuplicates(["vector"]).orderBy("h").limit(cells).collect()])  # at most MOST_CELLS
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = unit(first)
    for _ in range(ROUNDS):
        shared = sc.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(shared.value), np.zeros(len(shared.value))
            for b in batches:
                x = _matrix(b.column("vector"))
                near = (x @ shared.value.T).argmax(axis=1)
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=len(n))
            for c in np.flatnonzero(n).tolist():
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "sum": pa.array([total[c].tobytes()], pa.binary())})

        # for each task and cell a row of sums, of a bounded sample
        moved = centres.copy() * 0
        for r in some.select("vector").mapInArrow(sums, "cell int, sum binary").collect():
            moved[r["cell"]] += np.frombuffer(r["sum"])
        empty = ~moved.any(axis=1)
        moved[empty] = centres[empty]
        if np.allclose(unit(moved), centres):
            break
        centres = unit(moved)
    return centres


class VectorIndex:
    """The index, in ``path``, of a keyed table with ``key`` and ``vector`` (a collection: ``FileSink.table``)."""

    def __init__(self, spark: SparkSession, table: KeyedTable, path: str, cells: int | None = None):
        self.spark, self.table, self.path, self.wanted, self.key = spark, table, str(path).rstrip("/"), cells, table.keys[0]
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _state(self) -> dict | None:
        """What the last refresh has written down: folders of the collection and of the index, and how many vectors are in the fullest cells."""
        if not self._fs.exists(self._p(self.path)):
            return None
        numbers = sorted(int(s.getPath().getName()[2:]) for s in self._fs.listStatus(self._p(self.path)) if s.getPath().getName().startswith("s-"))
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/s-{numbers[-1]}").first()[0]) | {"number": numbers[-1]} if numbers else None

    def refresh(self) -> None:
        """Bring the index up to the collection's last commit."""
        state, folders = self._state(), self.table.folders()
        if state and state["collection"] == folders or not folders:
            return
        follows = state is not None and folders[: len(state["collection"])] == state["collection"]
        log = self.table._log(folders[len(state["collection"]) :] if follows else folders)
        log = log.select(self.key, "vector", "__seq", "__gone")
        if not follows:
            rows = self.table.read().where("vector is not null and size(vector) > 0").select(self.key, "vector")
            n = rows.count()
            centres = centres_of(rows, self.key, min(MOST_CELLS, self.wanted or max(1, int(n**0.5))))
            folder = f"{self.path}/centres-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(folder)
            state = {"centres": folder, "index": [], "changed": [], "number": state["number"] if state else -1}
            rows = rows.withColumn("seq", F.lit(-1).cast("long"))
        else:
            rows = log.where("not __gone and vector is not null and size(vector) > 0").select(self.key, "vector", F.col("__seq").alias("seq"))
            changed = f"{self.path}/changed-{uuid.uuid4().hex}"
            log.groupBy(self.key).agg(F.max(F.struct("__seq", "__gone")).alias("l")).select(self.key, F.col("l.__seq").alias("seq"), F.col("l.__gone").alias("gone")).write.parquet(changed)
            state["changed"].append(changed)
        placed = _cells(rows, self._centres(state), "vector", 1).select(self.key, "vector", "seq", F.col("cells")[0].alias("cell"))
        part = f"{self.path}/cells-{uuid.uuid4().hex}"
        placed.repartition("cell").withColumn("row", F.monotonically_increasing_id() + (len(state["index"]) << 52)).write.partitionBy("cell").parquet(part)
        state["index"].append(part)
        full = self._rows(state).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BASE_BLOCK).collect()  # cells, at most MOST_CELLS
        new = {"collection": folders, "centres": state["centres"], "index": state["index"], "changed": state["changed"], "slices": {str(r["cell"]): -(-r["n"] // BASE_BLOCK) for r in full}}
        stream = self._fs.create(self._p(f"{self.path}/s-{state['number'] + 1}"), False)
        stream.writeBytes(json.dumps(new))
        stream.close()

    def _centres(self, state: dict):
        rows = self.spark.read.parquet(state["centres"]).orderBy("cell").collect()
        return self.spark.sparkContext.broadcast(np.array([r["centre"] for r in rows]))

    def _rows(self, state: dict) -> DataFrame:
        kind = next(f.dataType for f in self.table.schema if f.name == self.key).simpleString()
        return self._union([self.spark.read.schema(f"`{self.key}` {kind}, vector array<float>, seq long, row long, cell int").parquet(p) for p in state["index"]])

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def candidates(self, cells: list[int] | None = None) -> DataFrame:
        """(key, vector, row, cell) of the collection's points as of the last refresh, of some cells: only their files are read."""
        state = self._state()
        if state is None:
            raise ValueError(f"nothing is indexed in {self.path}: refresh it first")
        rows = self._rows(state)
        rows = rows if cells is None else rows.where(F.col("cell").isin(cells))
        if not state["changed"]:
            return rows.drop("seq")
        changed = self._union([self.spark.read.parquet(p) for p in state["changed"]]).groupBy(F.col(self.key).alias("k")).agg(F.max("seq").alias("last"))
        # a row counts unless its point has changed after it; a deletion is a change without a row of its own
        return rows.join(changed, F.col(self.key) == F.col("k"), "left").where("last is null or seq >= last").drop("seq", "k", "last")

    def search(self, queries: DataFrame, k: int, probes: int | None = 8) -> DataFrame:
        """(query_id, rank, key, score): the ``k`` points of largest inner product with each of ``queries`` (id, vector) in the ``probes`` cells nearest to it; in all cells, exactly, if None."""
        state = self._state()
        if state is None:
            raise ValueError(f"nothing is indexed in {self.path}: refresh it first")
        centres = self._centres(state)
        n = len(centres.value)
        asked = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        if probes is None:
            held = self.candidates()
            found = nearest(asked, held.select(F.col("row").alias("id"), "vector"), k, exclude_same_id=False)
            return found.withColumnRenamed("id", "row").join(held.select("row", self.key), "row").select("query_id", "rank", self.key, "score")
        asked = _cells(asked, centres, "vector", min(probes, n)).select("id", "vector", F.explode("cells").alias("cell"))
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
        held = self.candidates(cells)
        # a cell with very many vectors is sliced, and its queries meet every slice
        slices = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(state["slices"])), "map<string,int>"), F.col("cell").cast("string")), F.lit(1))
        n_chunks = max(1, -(-queries.count() // QUERY_CHUNK))
        chunk, block = F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int"), lambda s: (F.col("cell") + F.lit(MOST_CELLS) * s).cast("int")
        q = asked.withColumn("s", F.explode(F.sequence(F.lit(0), slices - 1))).select(F.lit(1).alias("probe"), block(F.col("s")).alias("block"), chunk.alias("chunk"), "id", "vector")
        b = held.select(F.lit(0).alias("probe"), block(F.pmod(F.xxhash64("row"), slices)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), F.col("row").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        found = meet(b, q, k, False)
        return found.withColumnRenamed("id", "row").join(held.select("row", self.key), "row").select("query_id", "rank", self.key, "score")

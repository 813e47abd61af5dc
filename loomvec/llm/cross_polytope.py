"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and hashed to
the signed axis it is nearest to. A table's hash joins the axes of one or more such rotations, so that its cells grow in
number with the vectors; each of several tables has its own rotations. A query probes in each table the cells it
is nearest to, not just its own (the order is by the squared shortfall of its coordinate from the nearest axis'), and the
vectors found there are candidates, reranked by their exact inner product with it in double precision.

How many cells are probed is measured, not set: for ``PILOTS`` queries (those of the smallest hash) the exact neighbours are found by
one pass over all vectors, and the least number of probes is taken that meets ``recall`` of them. A query that then meets
fewer than k vectors probes four times as many cells, and so on, until it has k or has seen all.

Nearness is the inner product, and vectors needn't be of unit length: they are dealt into bands of similar
length, and within a band a vector scaled by the band's largest length gets one more coordinate that completes it to a
unit vector, which turns inner products into angles. The queries' extra coordinate is zero.

Candidates never become rows. A cell's vectors and the probes of it meet in one task, in slices of bounded
size; each slice is compared by matrix products. Of equal vectors only the k + 1 smallest ids can be among anyone's nearest, so no more
are indexed, and equal queries ask once: a vector that a third of all rows share costs what one row does.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, as queries or candidates, nor do
those of another dimension than most, as between dimensions there is no inner product; rows with a null id are candidates of no
one. A query's candidates are all rows but itself: of rows that repeat an id each asks, and each is found. Ties go to the smaller id.
No valid vectors give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import checkpointed

#: Vectors of a cell on average, once a table has more than FEWEST cells.
CELL = 1024
FEWEST = 256
#: Vectors of a slice, and slices at most that a table's cells may be cut into before slices grow.
SLICE = 4096
MOST_SLICES = 1 << 16
#: Queries whose exact neighbours tell how many cells to probe.
PILOTS = 128
#: Entries that a task holds before it merges them by query.
HELD = 1 << 18


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (width a power of two) under rounds of random signs and the Hadamard transform, kept at unit scale."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def table_signs(table: int, width: int, seed: int, level: int = 0) -> np.ndarray:
    return np.random.default_rng([seed, table, level]).choice([-1.0, 1.0], (3, width))


def signed_axes(x: np.ndarray) -> np.ndarray:
    """Each row's nearest signed axis: i for +i, width + i for -i."""
    i = np.abs(x).argmax(axis=1)
    return i + x.shape[1] * (x[np.arange(len(x)), i] < 0)


def levels_for(n: int, width: int) -> list[int]:
    """Coordinates that each rotation of a hash looks at: twice their product is the number of cells."""
    cells = max(min(2 * width, FEWEST), 1 << max(0, -(-n // CELL) - 1).bit_length())
    levels = []
    while cells > 1:
        levels.append(min(width, cells // 2))
        cells //= 2 * levels[-1]
    return levels


class Tables:
    """The rotations of all tables; small enough to travel with a task."""

    def __init__(self, d: int, n: int, tables: int, seed: int):
        self.d, self.width, self.tables = d, width_for(d), tables
        self.levels = levels_for(n, self.width)
        self.signs = [[table_signs(t, self.width, seed, i) for i in range(len(self.levels))] for t in range(tables)]

    @property
    def cells(self) -> int:
        return int(np.prod([2 * m for m in self.levels], dtype=object))

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Each row's cell in table ``t``."""
        code = np.zeros(len(x), np.int64)
        for m, signs in zip(self.levels, self.signs[t], strict=True):
            code = code * (2 * m) + signed_axes(rotate(x, signs)[:, :m])
        return code

    def probes(self, x: np.ndarray, t: int, most: int) -> np.ndarray:
        """Each row's ``most`` nearest cells in table ``t``, nearest first."""
        code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for m, signs in zip(self.levels, self.signs[t], strict=True):
            y = rotate(x, signs)[:, :m]
            short = np.square(np.abs(y).max(axis=1, keepdims=True) - np.concatenate([y, -y], axis=1))
            loss = (loss[:, :, None] + short[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * m) + np.arange(2 * m)).reshape(len(x), -1)
            # the cells nearest in all are nearest so far, so no more need be kept
            keep = np.argpartition(loss, most - 1, axis=1)[:, :most] if most < loss.shape[1] else np.arange(loss.shape[1])[None].repeat(len(x), 0)
            loss, code = np.take_along_axis(loss, keep, 1), np.take_along_axis(code, keep, 1)
        order = np.lexsort((code, loss), axis=1)
        return np.take_along_axis(code, order, 1)

    def unit(self, vecs: np.ndarray, scale: np.ndarray, complete: bool) -> np.ndarray:
        x = np.zeros((len(vecs), self.width))
        x[:, : self.d] = vecs / scale[:, None]
        if complete:
            x[:, self.d] = np.sqrt(np.maximum(0.0, 1.0 - np.square(x[:, : self.d]).sum(axis=1)))
        return x


def width_for(d: int) -> int:
    return 1 << max(1, d).bit_length()  # room for the completing coordinate


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


#: Stands for a null id inside: after all others. A row that has it as its id is taken for one without.
NO_ID = (1 << 63) - 1


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(uid, id, vec as bytes of doubles, norm) of the rows that take part, and the dimension."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = common["d"] if common else 1
    rows = rows.where(F.size("v") == d).withColumn("uid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            with np.errstate(over="ignore"):
                scale = np.abs(x).max(axis=1)
                norm = scale * np.sqrt(np.square(x / scale[:, None]).sum(axis=1))
            yield pa.RecordBatch.from_pydict({"uid": b.column("uid"), "id": b.column("id"), "vec": pa.array([r.tobytes() for r in x], pa.binary()), "norm": pa.array(norm)})

    return rows.mapInArrow(run, "uid long, id long, vec binary, norm double"), d


def best_of(query: np.ndarray, vecs: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, uids, scores) of each query's best ``k``, best first, with exact scores."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(query @ vecs.T, nan=-np.inf)
    edges = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(query), -np.inf)
    for row, edge, q in zip(rough, edges, query, strict=True):
        open_ = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.arange(len(ids))  # with all that rounding might tie
        with np.errstate(over="ignore", invalid="ignore"):
            score = (vecs[open_] * q).sum(axis=1)  # one order of summation for every pair
        top = np.lexsort((uids[open_], ids[open_], -score))[:k]
        yield ids[open_][top], uids[open_][top], score[top]


class Merge:
    """The best ``k`` entries of each query among all that a task has found; holds little, and hands on when it is full."""

    def __init__(self, k: int):
        self.k, self.held, self.n = k, [], 0

    def add(self, qkey: int, ids: np.ndarray, uids: np.ndarray, scores: np.ndarray) -> bool:
        self.held.append((np.full(len(ids), qkey, np.int64), ids, uids, scores))
        self.n += len(ids)
        return self.n >= HELD

    def take(self) -> pa.RecordBatch:
        columns = [np.concatenate([h[i] for h in self.held]) if self.held else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64))]
        self.held, self.n = [], 0
        order = np.lexsort((columns[2], columns[1], -columns[3], columns[0]))
        q, ids, uids, s = (c[order] for c in columns)
        again = np.zeros(len(q), bool)
        again[1:] = (q[1:] == q[:-1]) & (uids[1:] == uids[:-1])  # met in several tables: equal scores, so side by side
        q, ids, uids, s = (c[~again] for c in (q, ids, uids, s))
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < self.k
        q, ids, uids, s = (c[keep] for c in (q, ids, uids, s))
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        entries = pa.StructArray.from_arrays([pa.array(-s), pa.array(ids), pa.array(uids)], names=["s", "id", "uid"])
        return pa.RecordBatch.from_pydict({"qkey": pa.array(q[start], pa.int64()), "best": pa.ListArray.from_arrays(pa.array(np.r_[start, len(q)], pa.int32()), entries)})


FOUND = "qkey long, best array<struct<s:double,id:long,uid:long>>"


def merged(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("qkey").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))


def probes_needed(pilots: list, nearest: dict, tables: Tables, recall: float) -> int:
    """The least number of probes that meets ``recall`` of the pilots' exact neighbours, given each neighbour's cells."""
    most = 16
    while True:
        most = min(most, tables.cells)
        ranks: list[int] = []
        for p in pilots:
            cells = np.array([list(c) for c in nearest[p["qkey"]]], np.int64).reshape(-1, tables.tables)
            x = tables.unit(np.frombuffer(p["vec"], np.float64)[None], np.array([p["norm"]]), False)
            rank = np.full(len(cells), tables.cells)
            for t in range(tables.tables):
                probed = tables.probes(x, t, most)[0]
                order = np.argsort(probed)
                at = np.minimum(np.searchsorted(probed[order], cells[:, t]), len(probed) - 1)
                rank = np.where(probed[order][at] == cells[:, t], np.minimum(rank, order[at]), rank)
            ranks.extend(rank.tolist())
        need = int(np.sort(ranks)[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if ranks else 1
        if need <= most or most == tables.cells:
            return min(need, tables.cells)
        most *= 4


def search(vectors: DataFrame, is_query, k: int = 20, tables: int = 8, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for the vectors whose id satisfies ``is_query`` (a function of the id column), the nearest found.

    ``report``, if given, gets the number of indexed vectors, cells and probes.
    """
    valid, d = valid_vectors(vectors, id_col, vector_col)
    valid = checkpointed(valid)
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id", "uid"))  # the filter goes before the shuffle, so a hot vector is k + 1 rows a task
    base = valid.withColumn("copy", copy).where(F.col("copy") <= k + 1)
    banded = base.withColumn("band", F.round(F.log("norm") / float(np.log(1.25))).cast("int"))
    banded = checkpointed(banded.drop("copy"))
    longest = banded.groupBy("band").agg(F.max("norm").alias("longest"))  # a row for each factor of 1.25 between norms: at most 6,400
    n = banded.count()
    index = Tables(d, n, tables, seed)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = index.unit(matrix(b.column("vec"), d), b.column("longest").to_numpy(), True)
                codes = np.stack([index.codes(x, t) for t in range(tables)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_pydict({"uid": b.column("uid"), "id": b.column("id"), "vec": b.column("vec"), "codes": lists})

    hashed = checkpointed(banded.join(F.broadcast(longest), "band").mapInArrow(hash_rows, "uid long, id long, vec binary, codes array<long>"))
    in_cells = hashed.select("uid", "id", "vec", F.posexplode("codes").alias("t", "code"))
    slice_rows = max(SLICE, n // MOST_SLICES)
    crowded = in_cells.groupBy("t", "code").count().where(F.col("count") > slice_rows)
    hot = {(r["t"], r["code"]): -(-r["count"] // slice_rows) for r in crowded.collect()}  # at most MOST_SLICES of each table

    asking = valid.where(is_query(F.col("id")))
    queries = checkpointed(asking.groupBy("vec").agg(F.min("uid").alias("qkey"), F.min("norm").alias("norm")))
    pilots = queries.orderBy(F.xxhash64("vec"), "qkey").limit(PILOTS).collect()
    pilot_keys = [p["qkey"] for p in pilots]
    pilot_vecs = np.stack([np.frombuffer(p["vec"], np.float64) for p in pilots]) if pilots else np.zeros((0, d))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merge(k + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                ids, uids = b.column("id").to_numpy(), b.column("uid").to_numpy()
                for q, found in zip(pilot_keys, best_of(pilot_vecs, matrix(b.column("vec"), d), ids, uids, k + 1), strict=True):
                    if merge.add(q, *found):
                        yield merge.take()
        yield merge.take()

    exact = merged(hashed.mapInArrow(scan, FOUND), k + 1).select("qkey", F.explode("best.uid").alias("uid"))
    codes_of = {q: [] for q in pilot_keys}
    for r in exact.join(hashed.select("uid", "codes"), "uid").where("uid != qkey").collect():  # PILOTS x (k + 1) rows
        codes_of[r["qkey"]].append(r["codes"])
    probes = probes_needed(pilots, codes_of, index, recall)
    if report is not None:
        report.update(indexed=n, cells=index.cells, probes=probes, tables=tables)

    def probe_rows(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = max(1, min(512, (1 << 21) // (most * 2 * max(index.levels))))
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    b = whole.slice(at, rows)
                    x = index.unit(matrix(b.column("vec"), d), b.column("norm").to_numpy(), False)
                    for t in range(tables):
                        code = index.probes(x, t, most)
                        row, code = np.repeat(np.arange(len(x)), code.shape[1]), code.reshape(-1)
                        copies = np.array([hot.get((t, c), 1) for c in code.tolist()], np.int64)
                        row, code = np.repeat(row, copies), np.repeat(code, copies)
                        part = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                        for lo in range(0, len(row), 4096):
                            own = slice(lo, lo + 4096)
                            own_rows = b.take(pa.array(row[own]))
                            yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(own_rows.num_rows, t, np.int32)), "code": pa.array(code[own]), "slice": pa.array(part[own], pa.int32()), "probe": pa.array(np.ones(own_rows.num_rows, np.int32)), "uid": own_rows.column("qkey"), "id": own_rows.column("qkey"), "vec": own_rows.column("vec")})

        return run

    shares = F.broadcast(vectors.sparkSession.createDataFrame([(t, c, s) for (t, c), s in hot.items()], "t int, code long, slices long"))  # at most tables x MOST_SLICES rows
    key = ["t", "code", "slice"]
    sliced = in_cells.join(shares, ["t", "code"], "left").withColumn("slice", F.pmod(F.xxhash64("uid"), F.coalesce("slices", F.lit(1))).cast("int"))
    sliced = sliced.select(*key, F.lit(0).alias("probe"), "uid", "id", "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, base_rows, vecs, ids, uids, merge = None, [], None, None, None, Merge(k + 1)
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in (*key, "probe")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                own = tuple(keys[lo, :3])
                if own != at_key:
                    at_key, base_rows, vecs = own, [], None
                if not keys[lo, 3]:
                    base_rows.append(whole.slice(lo, hi - lo))
                    continue
                if vecs is None and base_rows:
                    vecs = np.concatenate([matrix(b.column("vec"), d) for b in base_rows])
                    ids = np.concatenate([b.column("id").to_numpy() for b in base_rows])
                    uids = np.concatenate([b.column("uid").to_numpy() for b in base_rows])
                if vecs is None:
                    continue
                for at in range(lo, hi, 256):
                    b = whole.slice(at, min(256, hi - at))
                    for q, found in zip(b.column("uid").to_pylist(), best_of(matrix(b.column("vec"), d), vecs, ids, uids, k + 1), strict=True):
                        if merge.add(q, *found):
                            yield merge.take()
        yield merge.take()

    def ask(who: DataFrame, most: int) -> DataFrame:
        asked = who.mapInArrow(probe_rows(most), "t int, code long, slice int, probe int, uid long, id long, vec binary")
        # a slice's vectors come first, then any number of probes: only the slice is held
        rows = sliced.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "probe")
        return merged(rows.mapInArrow(meet, FOUND), k + 1)

    want = min(k + 1, n)
    found = checkpointed(queries.select("qkey", "vec").join(ask(queries, probes), "qkey", "left"))
    while probes < index.cells:
        short = found.where(F.coalesce(F.size("best"), F.lit(0)) < want)
        if short.isEmpty():
            break
        probes = min(4 * probes, index.cells)
        again = queries.join(short.select("qkey"), "qkey", "left_semi")
        more = short.select("qkey", "vec").join(ask(again, probes), "qkey", "left")
        found = checkpointed(found.where(F.size("best") >= want).unionByName(more))

    others = F.slice(F.filter("best", lambda b: b["uid"] != F.col("uid")), 1, k)
    lists = asking.select("uid", "id", "vec").join(found.select("vec", "best"), "vec").select("id", others.alias("best"))
    return lists.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.when(F.col("b.id") != NO_ID, F.col("b.id")).alias("vec_id"), (-F.col("b.s")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 20 == 0)

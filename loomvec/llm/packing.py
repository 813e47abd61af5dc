"""Best-fit packing by minimum bin slack.

Every document's token ids plus an end id are cut into pieces of at most ``capacity`` tokens (only documents
longer than that are cut), and pieces are packed into as few sequences as the method finds. Lengths are
integers up to the capacity, so all that packing needs to know is how many pieces there are of each length: at
most ``capacity`` counts, whatever the input. On those the driver repeats: take the longest length left, find by
bitset subset-sum dynamic programming the fullest combination of available lengths that fits beside it, remove it as
often as the counts allow. Each such pattern covers a range of ranks of each of its lengths; on the
executors a piece's rank among the pieces of its length gives its sequence and offset. Ranks are counted
within slices of a length, as many as its pieces ask for, so a length that very many pieces share is not one task's work.

Defined results: null and empty texts are one piece holding the end id alone; an empty table gives no rows.
Repeated rows are packed once each. Which of several equal pieces gets which place is fixed by the order of
(doc_id, piece, crc), with no meaning of its own. Very long texts are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import blocks, checkpointed, small_batches, spread, trimmed
from loomvec.llm.encoding import default_path, worker_encoder

CAPACITY = 2048
END_ID = 0
#: Slices up to which their table is broadcast.
PLAN_ROWS = 100_000


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""
    path = path or default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for b in blocks(batch, "text"):
                cols: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            cols[c].append(v)
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in cols.items() if c != "ids" or with_ids})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return small_batches(spread(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``; longer lengths are preferred."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # counts as powers of two, so each is one shift of the whole set
            take = min(k, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: pieces in each sequence}) until every piece is used."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = fullest(left, capacity - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        repeats = min(left[n] // k for n, k in bin_.items())
        out.append((repeats, bin_))
        for n, k in bin_.items():
            left[n] -= repeats * k
            if not left[n]:
                del left[n]
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces in each sequence, first sequence, offset in the sequence) of each pattern and length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, bin_ in found:
        offset = 0
        for length in sorted(bin_, reverse=True):
            k = bin_[length]
            out.append((length, used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + repeats * k
            offset += k * length
        sequence += repeats
    return out


def pack(table: DataFrame, capacity: int = CAPACITY, slice_rows: int = 100_000) -> DataFrame:
    """``table`` (of ``pieces``; read twice, so it should be materialised) with ``sequence_id`` and ``offset``."""
    spark = table.sparkSession
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    # slices follow the rows of a length; the table of how many has at most capacity rows
    many = spark.createDataFrame([(length, -(-n // slice_rows)) for length, n in counts.items()], "length long, __slices long")
    sliced = table.join(F.broadcast(many), "length").withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__slices"))).drop("__slices")
    hist = sliced.groupBy("length", "__slice").agg(F.count("*").alias("n")).collect()  # a row for every slice_rows pieces, and capacity more
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, first, each, sequence, offset in places(patterns(counts, capacity)):
        runs.setdefault(length, []).append((first, each, sequence, offset))
    firsts = {length: [r[0] for r in own] for length, own in runs.items()}
    rows, at = [], dict.fromkeys(counts, 0)
    for r in sorted(hist, key=lambda r: (r["length"], r["__slice"])):
        length, start, end = r["length"], at[r["length"]], at[r["length"]] + r["n"]
        # a slice's ranks meet few of its length's runs
        rows.append((length, r["__slice"], start, runs[length][bisect_right(firsts[length], start) - 1 : bisect_left(firsts[length], end)]))
        at[length] = end
    plan = spark.createDataFrame(rows, "length long, __slice long, __start long, runs array<struct<first:long,each:long,sequence:long,offset:long>>")
    ranked = sliced.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__slice").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    # short if there are few slices; else a join like any other
    placed = ranked.join(F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan, ["length", "__slice"]).withColumn("__rank", F.col("__rank") + F.col("__start"))
    placed = placed.withColumn("__run", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("__rank")), -1))
    into = F.col("__rank") - F.col("__run.first")
    return placed.select(*table.columns, (F.col("__run.sequence") + F.expr("(__rank - __run.first) div __run.each")).alias("sequence_id"), (F.col("__run.offset") + (into % F.col("__run.each")) * F.col("length")).alias("offset"))


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ids as little-endian unsigned 32-bit values."""
    packed = pack(checkpointed(pieces(docs, path, capacity, end_id, with_ids=True)), capacity)
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(transform(p, x -> x.ids), x'', (a, b) -> a || b)").alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """Place of every piece of every whole document."""
    return pack(checkpointed(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets."""
    return pack(checkpointed(pieces(docs)))

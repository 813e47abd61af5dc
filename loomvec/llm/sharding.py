"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt to source parts by a hash of the row and of its number among equal rows. The part sizes and the wanted shard sizes
fix the margins of a matrix of how many rows go from each part to each shard; under a uniform shuffle
that matrix is multivariate hypergeometric, and it is drawn so, on the driver, from counts alone. Each part is
permuted locally and cut by its row of the matrix, rows are exchanged, and each shard is permuted again. The law
is ``rows``: shard sizes differ by at most one, and where a row goes depends on nothing in it.

Everything on the executors is DataFrame operations. Permutations are orders by seeded hashes, so a lost
task is redone identically. There are at least as many parts as shards on any table, and one for every ``part_rows`` rows, up to ``most_parts``, beyond which parts grow and are sorted on disk. Equal
rows are counted before they are dealt and numbered, so they go to all parts alike, however many there are. The final
order of a shard is counted within slices of its hash range, as many as the rows ask for.

Defined results: null texts count as empty; repeated rows are separate rows (hash ties are only between
equal rows, which are interchangeable); rows with columns of types that can't be grouped by aren't numbered, so equal ones share a part; an empty table gives no rows; a text's length plays no part but in ``size``. Extra columns are kept by ``shard``.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hypergeometric(good: int, bad: int, drawn: int, rng: random.Random) -> int:
    """Number of good items among ``drawn`` of ``good + bad``: exact inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - p
    if u <= 0:
        return mode
    up, down, p_up, p_down = mode, mode, p, p
    while True:
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if up == high and down == low or p_up < 1e-300 and p_down < 1e-300:  # rounding left a crumb
            return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each part to each shard, with exactly these margins, as a uniform shuffle would send them."""
    rng = random.Random(seed)
    left = list(shards)
    out = []
    for size in parts:
        row, drawn, rest = [], size, sum(left)
        for s, room in enumerate(left):
            rest -= room
            k = hypergeometric(room, rest, drawn, rng) if s < len(left) - 1 else drawn
            row.append(k)
            drawn -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def even_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def literal_table(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small table made of one JSON literal: no Python rows on the way."""
    one = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return one.select("r.*")


def numbered(df: DataFrame, together: int = 1000) -> DataFrame:
    """``df`` with ``__number``: equal rows are counted, on the map side first, and made again with numbers from 1, many of them by several tasks."""
    if any(kind.startswith(("map", "variant")) or "map<" in kind for _, kind in df.dtypes):
        return df.withColumn("__number", F.lit(1).cast("long"))
    counted = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("__n"))
    one = F.lit(1).cast("long")
    few = counted.where(F.col("__n") <= together).withColumn("__number", F.explode(F.sequence(one, F.col("__n"))))
    many = counted.where(F.col("__n") > together).withColumn("__from", F.explode(F.sequence(one, F.col("__n"), F.lit(together).cast("long"))))
    many = many.repartition("__from").withColumn("__number", F.explode(F.sequence(F.col("__from"), F.least(F.col("__n"), F.col("__from") + together - 1)))).drop("__from")
    return few.unionByName(many).drop("__n")


def shard(df: DataFrame, identity: list[Column], shards: int = 24, seed: int = 17, part_rows: int = 20_000, most_parts: int = 16_384, slice_rows: int = 200_000) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard); ``identity`` tells rows apart as far as they differ."""
    n = df.count()
    slices = 16 + n // (shards * slice_rows)
    n_parts = max(shards, min(most_parts, -(-n // part_rows)))
    key = numbered(df).withColumn("__h", F.xxhash64(F.lit(seed), *identity, "__number"))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__h")), F.lit(n_parts)).cast("int")
    key = key.withColumn("__part", part)
    sizes = {r["__part"]: r["n"] for r in key.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # at most most_parts rows
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], even_sizes(n, shards), seed)
    ends = [{"__part": p, "__ends": [sum(row[: s + 1]) for s in range(shards)]} for p, row in zip(order, matrix, strict=True)]
    plan = literal_table(df, ends, "__part:int,__ends:array<long>")
    tie = [F.col(c) for c in key.columns if c not in ("__part",) and dict(key.dtypes)[c].split("<")[0] not in ("map", "variant")]
    ranked = key.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 2), "__h"), *tie)))
    sent = ranked.join(plan, "__part").withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))).cast("int"))
    sent = sent.withColumn("__again", F.xxhash64(F.lit(seed + 3), "__h", "__part", "__rank"))
    # slices of the hash range in ascending order, so slice starts are running counts
    sent = sent.withColumn("__slice", (F.shiftright("__again", 40) + (1 << 23)) * slices / (1 << 24)).withColumn("__slice", F.floor("__slice").cast("int"))
    counts = sent.groupBy("shard", "__slice").agg(F.count("*").alias("n"))  # shards x slices rows
    starts = counts.select("shard", "__slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("__slice")) - F.col("n")).alias("__start"))
    placed = sent.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__slice").orderBy("__again", "__part", "__rank")) - 1)
    # bounded: shards x slices rows
    placed = placed.join(F.broadcast(starts), ["shard", "__slice"])
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")], "shard", (F.col("__start") + F.col("__at")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(thin, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

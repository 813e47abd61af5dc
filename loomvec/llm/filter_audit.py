"""Filter interaction audit: what each of five quality filters removes, whatever the order in which they are applied.

Documents fail (words: runs of anything but ASCII white space, case-sensitive) A with under 200 words, B if less than half of the
words are distinct, C if over 2 % of the characters are A-Z, D if any of ``#$%&*|`` occurs, and E if a document of smaller doc_id
has the same text.

Duplicates are found by sorting. Rows are dealt by ranges of (fingerprint of the text, doc_id) and sorted within a range by
fingerprint, whole text and doc_id, so a text's smallest doc_id comes before its copies and each row is compared with its predecessor, text
by text. A group of copies of any size is divided between ranges, since ranges split a fingerprint by doc_id. What lies at a boundary is settled afterwards: a range tells the
smallest doc_id of each text of its last fingerprint, and rows at the head of a range that found no smaller copy there look it up by SHA-256 of the text.
The same pass finds the other failures of a text, once for a run of copies.

Each document is then five bits. Bits are counted by part (source) into at most 32 additive counters with their labels, and all 120 orders
follow from the counters: a step removes those with its bit and none of the bits before.

Defined results: null texts count as empty (A only, and E if repeated); null sources count as the empty one; a document without a doc_id is nobody's smaller copy and has none; rows equal in doc_id
and text are not each other's duplicates; a document is good or toxic if any of its rows in ``labels`` says 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm._common import blocks, checkpointed, small_batches, table, trimmed
from loomvec.llm._words import texts_of, word_lists

#: Fixed values of the audit: filters by letter, their bits in this order, and signs that D looks for.
FILTERS = "ABCDE"
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(0x41, 0x5B))
CONTINUATION = bytes(range(0x80, 0xC0))
NOT_SIGNS = bytes(b for b in range(256) if b not in SIGNS)
NOT_CAPITALS = bytes(b for b in range(256) if b not in CAPITALS)


def failures(text: bytes) -> int:
    """Bits of A to D that a text fails."""
    words, distinct = 0, set()
    for some in word_lists(text):
        words += len(some)
        distinct.update(some)
    capitals, points = len(text.translate(None, NOT_CAPITALS)), len(text.translate(None, CONTINUATION))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | bool(text.translate(None, NOT_SIGNS)) << 3


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a sorted range, and one, without a mask, for each text of its last fingerprint.

    Rows of the first fingerprint that have no smaller copy here carry their text's digest, to be looked up in ranges before.
    """
    first = print_now = text_now = None
    low = mask = digest = None
    runs: list[tuple[bytes, int | None]] = []  # texts of the fingerprint at hand, whole ones, of which 64 bits are equal: hardly ever two

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "part", "mask", "print", "digest"])

    for batch in batches:
        for block in blocks(batch, "text"):
            rows = []
            for doc, part, fp, text in zip(*(block.column(c).to_pylist() for c in ("doc_id", "part", "print")), texts_of(block.column("text"))):
                if fp != print_now or text != text_now:
                    if fp != print_now:
                        runs = []
                    elif text_now is not None:
                        runs.append((hashlib.sha256(text_now).digest(), low))
                    first = fp if print_now is None else first
                    print_now, text_now, low, mask, digest = fp, text, None, failures(text), None
                repeated = low is not None and doc is not None and low < doc
                low = doc if low is None else low
                look = fp == first and doc is not None and not repeated
                if look and digest is None:
                    digest = hashlib.sha256(text).digest()
                rows.append((doc, part, mask | repeated << 4, fp if look else None, digest if look else None))
            yield out(rows)
    if print_now is not None:
        runs.append((hashlib.sha256(text_now).digest(), low))
        yield out([(doc, None, None, print_now, d) for d, doc in runs])


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document, bit k of ``mask`` for filter k; written to the shared folder once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = small_batches(rows).withColumn("print", F.xxhash64("text"))
    ranges = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    seen = checkpointed(ranges.mapInArrow(trimmed(_compare), "doc_id long, part string, mask int, print long, digest binary"))
    lows = seen.where("mask is null and doc_id is not null").groupBy("print", "digest").agg(F.min("doc_id").alias("low"))  # a few rows for each range
    settled = seen.where("mask is not null and digest is null").select("doc_id", "part", "mask")
    heads = seen.where("mask is not null and digest is not null").join(lows, ["print", "digest"], "left")
    return settled.union(heads.select("doc_id", "part", F.when(F.col("low") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask")))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts, at most 32 rows for each part."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = masks.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    unmarked = masks.where("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))  # no join on null: it would be one task's
    return marked.union(unmarked).groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def _orders() -> Column:
    """All steps of all orders, as one array: order, step, bits of the steps before, bit of the step."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "bit": bit})
            before |= bit
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")


def _total(which, what: str) -> Column:
    """Sum of a counter over the masks that ``which`` holds for."""
    return F.aggregate("held", F.lit(0).cast("long"), lambda a, e: a + F.when(which(e["mask"]), e[what]).otherwise(F.lit(0).cast("long")))


def interactions(counted: DataFrame) -> DataFrame:
    """Every order and step of every part, from its counters."""
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))  # at most 32
    rows = held.withColumn("at", F.explode(_orders())).select("part", "held", "at.*")
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # of the orders of the filters that a document fails, an equal share begins with each
    shapley = F.aggregate("held", F.lit(0).cast("long"), lambda a, e: a + F.when(fails(e["mask"]), e["n"] * F.lit(120) / F.bit_count(e["mask"])).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step", _total(lambda m: ~fails(m) & ~gone(m), "n").alias("kept"), _total(removed, "n").alias("removed"), _total(lambda m: fails(m) & gone(m), "n").alias("redundant"),
        _total(lambda m: m == F.col("bit"), "n").alias("unique_fails"), _total(removed, "good").alias("good_lost"), _total(removed, "toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic)."""
    return interactions(checkpointed(counters(failure_masks(docs), labels)))


def query(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
m AS (
  SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(low < doc_id, false)::INT AS mask FROM w
),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN marks USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

"""Document fingerprints by winnowing.

A text is cut into lower-cased tokens (letter and digit runs of at most 32, single characters of scripts written
without spaces, single other signs; white space is dropped). Every run of K tokens is a k-gram with a 64-bit hash, and
of every window of W consecutive k-grams the smallest hash is selected, the rightmost one on ties, with its
position. Any passage of at least K + W - 1 = 7 tokens that two texts share leaves a common selected hash; nothing
shorter than K tokens matches.

All of it is DataFrame array functions, linear in the text: k-gram hashes and window minima are built by doubling
(a gram of 4 from two of 2, a window of 4 from two of 2). To choose, a gram's upper hash bits and its inverted position share one
long, so that one minimum does both the choice and the tie; what is chosen is handed on with its whole 64-bit hash.

Defined results: null texts count as empty, and an empty text selects nothing; a text of fewer than K tokens is one gram;
two texts that select nothing have likeness 1. Order ties between equal ids go by a hash of the text; rows with
a null id come last in descending order. Very long texts are fingerprinted whole. Buckets are cut by rank, so neither clustered ids nor one that many rows
have make a large one; rows equal in id and text that would fill a bucket are computed once. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import checkpointed

#: Tokens of a gram and grams of a window (powers of two).
K = W = 4
#: Bits that hold an inverted position while grams are chosen; the upper bits of the hash have the rest.
POSITION_BITS = 28
LAST = (1 << POSITION_BITS) - 1
#: Scripts written without spaces, whose characters are tokens by themselves.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]{{1,32}}|[^\s\p{{L}}\p{{M}}\p{{N}}]"


def _pairs(a: Column, step: int, size: Column, join) -> Column:
    """Element i joined with element i + step."""
    n = F.greatest(size - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, step + 1, n), join)


def select(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``position`` and ``hash`` of the selected grams of ``text``, two arrays in order of position."""
    t = f"__t_{out}"
    # each step is a column of its own, as Catalyst computes a column once and an expression wherever it stands
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0), lambda x: F.xxhash64(x)))
    df = df.withColumn(f"{t}2", _pairs(F.col(t), 1, F.size(t), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(f"{t}4", _pairs(F.col(f"{t}2"), 2, F.size(f"{t}2"), lambda a, b: F.xxhash64(a, b)))
    grams = F.when(F.size(t) >= K, F.col(f"{t}4")).when(F.size(t) > 0, F.array(F.aggregate(t, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(f"{t}h", grams)
    df = df.withColumn(f"{t}g", F.transform(f"{t}h", lambda x, i: x.bitwiseAND(F.lit(~LAST)).bitwiseOR(F.lit(LAST) - i.cast("long"))))
    df = df.withColumn(f"{t}m", _pairs(F.col(f"{t}g"), 1, F.size(f"{t}g"), lambda a, b: F.least(a, b)))
    df = df.withColumn(f"{t}n", _pairs(F.col(f"{t}m"), 2, F.size(f"{t}m"), lambda a, b: F.least(a, b)))
    chosen = F.when(F.size(f"{t}g") >= W, F.col(f"{t}n")).when(F.size(f"{t}g") > 0, F.array(F.array_min(f"{t}g"))).otherwise(F.col(f"{t}g"))
    df = df.withColumn(f"{t}p", F.transform(F.array_distinct(chosen), lambda v: (F.lit(LAST) - v.bitwiseAND(F.lit(LAST))).cast("int")))
    return df.withColumn(out, F.struct(F.col(f"{t}p").alias("position"), F.transform(f"{t}p", lambda p: F.get(f"{t}h", p)).alias("hash"))).drop(t, *(f"{t}{s}" for s in "24hgmnp"))


def positions(selected: str | Column) -> Column:
    return (F.col(selected) if isinstance(selected, str) else selected)["position"]


def hashes(selected: str | Column) -> Column:
    return F.array_distinct((F.col(selected) if isinstance(selected, str) else selected)["hash"])


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two hash sets (array columns without repeats); 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out``: array of (position, hash) of the selected grams."""
    return select(df, text, out).withColumn(out, F.arrays_zip(F.col(out)["position"].alias("position"), F.col(out)["hash"].alias("hash")))


def _place(text_key: str = "text_key") -> Column:
    """Where a row stands in descending order of doc_id, nulls last, ties by ``text_key``: structs that compare so."""
    return F.struct(F.col("doc_id").isNull().cast("int").alias("nil"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("low"), F.col(text_key).alias("key"))


def _heads(places: DataFrame, rows_per_bucket: int, most_buckets: int) -> tuple[list[dict], DataFrame | None]:
    """The first place of every bucket, in order, from (doc_id, text_key, n) of all different rows, and those that more rows have than a bucket should hold.

    Places are sorted by range and numbered by running counts, so every bucket has its share of rows by rank, whatever their ids. The driver sees counts of
    ranges and the heads, at most ``most_buckets`` of them.
    """
    places = places.withColumn("at", _place()).withColumn("weight", F.when(F.col("n") <= rows_per_bucket, F.col("n")).otherwise(2))
    ranged = checkpointed(places.repartitionByRange("at").withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("weight").alias("n")).collect()}
    rows = sum(sizes.values())
    size = max(rows_per_bucket, -(-rows // most_buckets))
    before, start = 0, {}
    for k in sorted(sizes):
        start[k] = before
        before += sizes[k]
    base = F.get(F.from_json(F.lit(json.dumps([start.get(k, 0) for k in range(max(start, default=0) + 1)])), "array<long>"), F.col("range"))
    end = base + F.sum("weight").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    first = F.floor((F.col("end") - 1) / size) > F.floor((F.col("end") - F.col("weight") - 1) / size)
    heads = ranged.withColumn("end", end).where(first | (F.col("end") == F.col("weight"))).select("at.*").collect()
    heavy = ranged.where(F.col("n") > rows_per_bucket).select("doc_id", "text_key", "n")
    return sorted((h.asDict() for h in heads), key=lambda h: tuple(h.values())), heavy if heavy.limit(1).count() else None


def _bucket(heads: list[dict]) -> Column:
    """The bucket of ``at``: the last one whose head isn't behind it, by binary search in a constant array."""
    array = F.from_json(F.lit(json.dumps(heads)), "array<struct<nil:int,low:long,key:long>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, (len(heads) - 1).bit_length())))))
    fits = lambda at: (at < len(heads)) & (F.get(array, at) <= F.col("at"))
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(fits(found + step), found + step).otherwise(found))


def in_order(docs: DataFrame, rows_per_bucket: int = 400, most_buckets: int = 65_536) -> DataFrame:
    """(doc_id, text, text_key, copies, bucket, guest): documents dealt into buckets of neighbours by doc_id, one shuffle, no global sort.

    A bucket also gets, as ``guest``, the head of the next (after the last, of the first) in descending order, so that a window over the bucket sees every
    row's successor. Rows equal in id and text that would fill a bucket are two rows: all but one of them, whose successor is the like, and the last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("copies", F.lit(1).cast("long"))
    heads, heavy = _heads(rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")), rows_per_bucket, most_buckets)
    if heavy is not None:
        same = rows.doc_id.eqNullSafe(heavy.doc_id) & (rows.text_key == heavy.text_key)
        many = rows.join(heavy, same, "left_semi").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        many = many.withColumn("copies", F.explode(F.array(F.col("n") - 1, F.lit(1).cast("long"))))
        rows = rows.join(heavy, same, "left_anti").unionByName(many.select("doc_id", "text", "text_key", "copies"))
    if not heads:
        return rows.withColumn("bucket", F.lit(0)).withColumn("guest", F.lit(False))
    rows = rows.withColumn("at", _place()).withColumn("own", _bucket(heads))
    array = F.from_json(F.lit(json.dumps(heads)), "array<struct<nil:int,low:long,key:long>>")
    to = lambda bucket, guest: F.struct(bucket.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    own, before = to(F.col("own"), False), to(F.pmod(F.col("own") - 1, F.lit(len(heads))), True)
    sent = F.when(F.get(array, F.col("own")) == F.col("at"), F.array(own, before)).otherwise(F.array(own))
    return rows.withColumn("to", F.explode(sent)).select("doc_id", "text", "text_key", "copies", "to.bucket", "to.guest")


def compare(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they are; see ``query``."""
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text_key", F.col("copies").desc())
    rows = in_order(docs).withColumn("next_text", F.lead("text").over(w))
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("__half", F.floor(n / 2).cast("int"))
    rows = select(rows, "text", "__sel").withColumn("__set", hashes("__sel"))
    rows = rows.withColumn("__next_set", F.lead("__set").over(w)).where(~F.col("guest"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("__half")).cast("int")), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("__half"))))
    rows = select(rows, "edited", "__esel").withColumn("__eset", hashes("__esel"))
    rows = rows.withColumn("__near_edited", likeness("__set", "__eset")).withColumn("__near_next", likeness("__set", "__next_set"))
    rows = rows.withColumn("__copy", F.explode(F.when(F.col("copies") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "copies"))))
    return rows.select("doc_id", "n_chars", "text", "edited", F.col("__sel").alias("selected"), F.col("__esel").alias("edited_selected"), F.col("__near_edited").alias("near_edited"), F.col("__near_next").alias("near_next"))


def digest(selected: str) -> Column:
    """One string for a whole fingerprint, hashes and positions."""
    return F.sha2(F.concat_ws("|", *(F.concat_ws(",", F.col(selected)[part].cast("array<string>")) for part in ("position", "hash"))), 256)


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole document and of its edited text."""
    out = compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("selected").alias("fingerprint"), digest("edited_selected").alias("edited_fingerprint"), "near_edited", "near_next", F.size(positions("selected")).alias("n_selected"))

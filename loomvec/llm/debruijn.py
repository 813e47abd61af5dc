"""Substring dedup: remove every passage of at least K words that the corpus has had before.

Words are runs of anything but ASCII white space. The K-word windows of the corpus are the edges of a De Bruijn graph whose nodes are
runs of K - 1 words. An edge that occurs again later is a repeat, and every word that a repeat covers is removed; which
occurrence is the first goes by doc_id, then by position.

Sending every edge through a shuffle would move several times the input. Instead:

1. Each window has a minimizer, the run of M of its words with the smallest hash (the rightmost on ties). Successive windows with one minimizer form a path without a
   branch inside a text. Paths are what is moved: one row in place of some six edges.
2. Minimizers are counted. A minimizer that occurs once ends all its windows' business. Those that occur again are kept as bits of a filter of
   fixed size that goes to every task; it may let others pass, which changes nothing but the work.
3. Paths with such minimizers meet by minimizer and content. Of equal paths all but the first are repeats as a whole: a non-branching part of the graph.
4. Where a join finds that one minimizer has several different paths, the graph branches, and the first path of each kind is taken apart into its edges,
   which meet in the same way. Any edge's first occurrence is in the first of the paths that hold it, so this settles everything.
5. Successive repeats with one source at one distance are compacted to spans, whose words are read again, at the place itself and at the source's coordinates: a 128-bit
   digest of both must be the same. If hashes of 64 bits had ever deceived, the spans found would be given up and all of it done again with others.

A task settles copies among the texts it reads together before it sends anything, so of a passage that a third of all documents share, only firsts of
batches meet in a shuffle; the others are dealt by their documents. Texts are shuffled only if something of them is removed or is a source (by a filter of fixed size
as well), and rows equal in doc_id and text are added up before they are.

Defined results: null text counts as empty; a text with fewer than K words keeps everything; rows with one doc_id are ordered by a hash of the text, and a null doc_id comes after
all others; of rows equal in doc_id and text one is the first and all others are copies; texts of any length are read a piece at a time; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import Scratch, blocks, small_batches, spread, stored, table, trimmed
from loomvec.llm._words import SPACES, texts_of, word_lists

#: Words of a window (an edge), and of a minimizer.
K, M = 20, 8
#: Bits of a filter: 16 MB, whatever the corpus. More bits filter better on a larger one.
FILTER_BITS = 1 << 27
#: Bytes of texts that are hashed together.
SEGMENT = 4 << 20
DOC = ["d", "t1", "t2"]
LAST = np.uint64((1 << 24) - 1)
_IS_SPACE = np.array([b in SPACES for b in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One hash of two."""
    with np.errstate(over="ignore"):
        x = (a * _ODD) ^ b
        x ^= x >> np.uint64(29)
        x *= _MIX
        x ^= x >> np.uint64(32)
    return x


class Hashes:
    """64-bit hashes of the words of byte strings, by random values for bytes and powers for places."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(0, 1 << 64, 256, np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(1 << 16, rng.integers(0, 1 << 61, dtype=np.uint64) * np.uint64(8) + np.uint64(5)), dtype=np.uint64)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, where it starts)."""
        raw = np.frombuffer(data, np.uint8)
        word = ~_IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        lengths = ends - starts
        at = np.flatnonzero(word)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(at)) - np.repeat(first, lengths)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(self.byte[raw[at]] * self.power[place & 0xFFFF], first)
        return _mix(sums, lengths.astype(np.uint64)), starts


class Paths(NamedTuple):
    """Paths of successive windows with one minimizer, in order. ``edges``: hashes of all windows by the number of their first word."""

    start: np.ndarray
    n: np.ndarray
    minimizer: np.ndarray
    content: np.ndarray
    edges: np.ndarray


def paths(h: np.ndarray, text: np.ndarray, seed: int) -> Paths:
    """Paths of a run of words; ``text`` numbers the text that each word belongs to, and no window goes beyond one."""
    n = len(h)
    if n < K:
        z = np.zeros(0, np.uint64)
        return Paths(z.astype(np.int64), z.astype(np.int64), z, z, z)
    h2 = _mix(h[:-1], h[1:])
    h4 = _mix(h2[:-2], h2[2:])
    h8 = _mix(h4[:-4], h4[4:])
    h16 = _mix(h8[:-8], h8[8:])
    edges = _mix(h16[: n - K + 1], h4[16 : 16 + n - K + 1])
    # a minimizer's upper hash bits and its inverted place in one number: one minimum does the choice and the tie
    key = (h8 & ~LAST) | (LAST - np.arange(len(h8), dtype=np.uint64))
    low = key
    for step in (1, 2, 4, 5):  # of 2, 4, 8 and K - M + 1 = 13
        low = np.minimum(low[:-step], low[step:])
    at = (LAST - (low & LAST)).astype(np.int64)
    whole = np.flatnonzero(text[: n - K + 1] == text[K - 1 :])
    if not len(whole):
        return paths(h[:0], text[:0], seed)
    at = at[whole]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1))))
    start, length = whole[new], np.diff(np.append(new, len(whole)))
    offset = np.arange(len(whole)) - np.repeat(new, length)
    with np.errstate(over="ignore"):
        odd = np.random.default_rng(seed + 1).integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
        content = np.add.reduceat(edges[whole] * odd[offset], new)
    shape = ((at[new] - start) * K + length).astype(np.uint64)
    return Paths(start, length, h8[at[new]], _mix(content, shape), edges)


class Filter:
    """Which 64-bit keys may be in a set: two bits for each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bits(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(n_bits - 1)
        return _mix(keys, np.uint64(1)) & mask, _mix(keys, np.uint64(2)) & mask

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for bit in self.bits(keys, len(self.words) * 64):
            found &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """One key for each row of 64-bit columns."""
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = _mix(out, c.astype(np.uint64))
    return out


def _filter(rows: DataFrame, columns: list[str], n_bits: int):
    """A broadcast Filter that holds ``columns`` (longs) of all rows; its size is ``n_bits``, however many rows there are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.concatenate(Filter.bits(_keys([b.column(c).to_numpy().view(np.uint64) for c in columns]), n_bits))
            if len(bit):
                bit.sort()
                word = (bit >> np.uint64(6)).astype(np.int64)
                new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                held = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), new)
                yield pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(held.view(np.int64))], ["word", "bits"])

    # at most n_bits / 64 rows come to the driver
    found = rows.select(*columns).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    all_words = np.zeros(n_bits // 64, np.uint64)
    all_words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(Filter(all_words))


def _segments(batches: Iterator[pa.RecordBatch], hashes: Hashes, seed: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Paths]]:
    """(rows, row of each path, number of each path's first word in its text, paths): of many short texts together, or of a part of a long one."""
    for batch in batches:
        for rows in blocks(batch, "text"):
            texts = list(texts_of(rows.column("text")))
            if sum(map(len, texts)) <= size or len(texts) > 1:
                ends = np.cumsum([len(t) + 1 for t in texts])
                h, starts = hashes.of(b" ".join(texts))
                of = np.searchsorted(ends, starts, "right")
                first = np.searchsorted(of, np.arange(len(texts)))
                p = paths(h, of, seed)
                row = of[p.start]
                yield rows, row, p.start - first[row], p
                continue
            held, base, text = np.zeros(0, np.uint64), 0, texts[0]
            start = 0
            while start < len(text):
                end = start + size
                while end < len(text) and text[end] not in SPACES:
                    end += 1
                held = np.concatenate((held, hashes.of(text[start:end])[0]))
                p = paths(held, np.zeros(len(held), np.int8), seed)
                # the last path may go on in the next part, which begins with it
                done = len(p.start) if end >= len(text) else len(p.start) - 1
                if done > 0:
                    yield rows, np.zeros(done, np.int64), p.start[:done] + base, Paths(p.start[:done], p.n[:done], p.minimizer[:done], p.content[:done], p.edges)
                    if end < len(text):
                        base, held = base + int(p.start[done]), held[p.start[done] :]
                start = end


def _minimizers(seed: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(seed)
        for _, _, _, p in _segments(batches, hashes, seed, size):
            g, n = np.unique(p.minimizer, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    return run


MET = "g long, w long, d long, t1 long, t2 long, a long, n int, src_d long, src_t1 long, src_t2 long, src_a long, salt int"


def _meeting(seed: int, size: int, known, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by which equal paths (or the edges of paths) meet: those whose minimizer (or whole identity) ``known`` may hold.

    Of equal ones in a segment only the first is to meet others; the rest have their source already, and a salt of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, may = Hashes(seed), known.value
        for rows, row, at, p in _segments(batches, hashes, seed, size):
            doc = [rows.column(c).to_numpy() for c in DOC]
            if edges:
                keep = may.may_hold(_keys([p.minimizer, p.content, *(c.view(np.uint64)[row] for c in doc), at.astype(np.uint64)]))
            else:
                keep = may.may_hold(p.minimizer)
            row, at, n, g, w, start = row[keep], at[keep], p.n[keep], p.minimizer[keep], p.content[keep], p.start[keep]
            if edges and len(n):  # each path becomes its windows
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, at, g, w = np.repeat(row, n), np.repeat(at, n) + inner, np.repeat(g, n), p.edges[np.repeat(start, n) + inner]
                n = np.ones(len(row), np.int64)
            if not len(row):
                continue
            # order of the documents; rows that are the same document have the same rank
            order = np.lexsort((doc[2], doc[1], doc[0]))
            differ = np.concatenate(([0], np.cumsum(np.any([c[order][1:] != c[order][:-1] for c in doc], axis=0))))
            rank = np.empty(len(order), np.int64)
            rank[order] = differ
            by = np.lexsort((at, rank[row], w, g))
            row, at, n, g, w = row[by], at[by], n[by], g[by], w[by]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])))
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = (rank[row] != rank[row[head]]) | (at != at[head])
            keep = new | again  # the same place of the same document, read again, is nothing new
            row, at, n, g, w, again, head_row, head_at = row[keep], at[keep], n[keep], g[keep], w[keep], again[keep], row[head][keep], at[head][keep]
            arrays = [pa.array(x.view(np.int64)) for x in (g, w)] + [pa.array(c[row]) for c in doc] + [pa.array(at), pa.array(n.astype(np.int32))]
            arrays += [pa.array(x, mask=~again) for x in (*(c[head_row] for c in doc), head_at)] + [pa.array(np.where(again, 1 + (_mix(doc[0].view(np.uint64)[row], np.uint64(3)) >> np.uint64(44)).astype(np.int64), 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in MET.split(", ")])

    return run


def _firsts(met: DataFrame) -> DataFrame:
    """``met`` with the source of every row: the first place of what is equal to it, which for a first is null."""
    by = Window.partitionBy("g", "w", "salt").orderBy(*DOC, "a")
    first = F.first(F.struct(*DOC, "a")).over(by)
    out = met.withColumn("__first", first)
    own = F.col("__first") == F.struct(*DOC, "a")
    source = {f"src_{c}": F.when(F.col("salt") > 0, F.col(f"src_{c}")).when(~own, F.col("__first")[c]) for c in [*DOC, "a"]}
    return out.withColumns(source).drop("__first", "salt")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t1, t2, text): a key without nulls that orders documents. Only if some id repeats do hashes of the text belong to it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    d, null = F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("doc_id").isNull()
    ties = [F.xxhash64("text"), F.xxhash64(null, "text")] if repeats else [F.lit(0).cast("long"), null.cast("long")]
    return rows.select("doc_id", d.alias("d"), *(t.alias(c) for t, c in zip(ties, DOC[1:])), "text")


def spans(keyed: DataFrame, seed: int = 1, filter_bits: int = FILTER_BITS, segment: int = SEGMENT) -> DataFrame:
    """(d, t1, t2, a, n, src_d, src_t1, src_t2, src_a): ``n`` successive windows from word ``a`` on that also start earlier, at the source from word ``src_a`` on."""
    texts = spread(small_batches(keyed.select(*DOC, "text")))
    counted = texts.mapInArrow(trimmed(_minimizers(seed, segment)), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    again = _filter(counted.where("n > 1"), ["g"], filter_bits)
    whole = stored(_firsts(texts.mapInArrow(trimmed(_meeting(seed, segment, again, False)), MET)))
    kinds = whole.where("src_d is null").select("g", "w", *DOC, "a")
    branching = kinds.groupBy("g").count().where("count > 1").select("g")
    apart = _filter(kinds.join(branching, "g", "left_semi"), ["g", "w", *DOC, "a"], filter_bits)
    single = stored(_firsts(texts.mapInArrow(trimmed(_meeting(seed, segment, apart, True)), MET)))
    repeats = whole.where("src_d is not null").union(single.where("src_d is not null")).drop("g", "w")
    # successive repeats with one source at one distance are one span
    by = Window.partitionBy(*DOC).orderBy("a", "n", "src_d", "src_t1", "src_t2", "src_a")
    end = F.lag(F.col("a") + F.col("n")).over(by)
    follows = (end == F.col("a")) & (F.lag(F.col("src_a") - F.col("a")).over(by) == F.col("src_a") - F.col("a"))
    for c in DOC:
        follows = follows & (F.lag(f"src_{c}").over(by) == F.col(f"src_{c}"))
    marked = repeats.withColumn("new", F.coalesce((~follows).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*DOC, "run").agg(F.min("a").alias("a"), F.sum("n").alias("n"), *(F.first(f"src_{c}").alias(f"src_{c}") for c in DOC), F.min("src_a").alias("src_a"))
    return stored(out.drop("run"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay of each text, as their digest, and digests of the spans asked for."""
    for batch in batches:
        for rows in blocks(batch, "text"):
            made = []
            for text, asked in zip(texts_of(rows.column("text")), rows.column("asked")):
                asked = asked.as_py() or []
                sha, first, seen, removed = hashlib.sha256(), True, 0, 0
                digests = [hashlib.blake2b(digest_size=16) for _ in asked]
                for words in word_lists(text):
                    keep = np.ones(len(words), bool)
                    for x, digest in zip(asked, digests):
                        lo, hi = max(x["a"] - seen, 0), min(x["a"] + x["n"] + K - 1 - seen, len(words))
                        if lo < hi:
                            digest.update(b" ".join(words[lo:hi]) + b" ")
                            if x["own"]:
                                keep[lo:hi] = False
                    kept = words if keep.all() else [w for w, k in zip(words, keep) if k]
                    if kept:
                        sha.update((b"" if first else b" ") + b" ".join(kept))
                        first = False
                    removed += len(words) - len(kept)
                    seen += len(words)
                made.append((seen, removed, sha.hexdigest(), [{"a": x["a"], "n": x["n"], "own": x["own"], "digest": d.digest()} for x, d in zip(asked, digests)]))
            n_words, n_removed, kept_sha, found = zip(*made)
            of = pa.list_(pa.struct([("a", pa.int64()), ("n", pa.int64()), ("own", pa.bool_()), ("digest", pa.binary())]))
            columns = [rows.column(c) for c in ("doc_id", *DOC, "copies")] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_sha), pa.array(found, of)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *DOC, "copies", "n_words", "n_removed", "kept_sha256", "found"])


def _texts(keyed: DataFrame, asked: DataFrame, wanted) -> DataFrame:
    """Every document with what is asked of it. Only those that ``wanted`` may hold are shuffled, equal rows as one."""

    @F.pandas_udf("boolean")
    def may(d, t1, t2):
        return type(d)(wanted.value.may_hold(_keys([c.to_numpy().view(np.uint64) for c in (d, t1, t2)])))

    marked = keyed.withColumn("some", may(*DOC))
    alone = marked.where(~F.col("some")).select("doc_id", *DOC, "text", F.lit(1).cast("long").alias("copies"), F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"))
    together = marked.where("some").groupBy(*DOC).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    return alone.unionByName(together.join(asked, DOC, "left").select("doc_id", *DOC, "text", "copies", "asked"))


def remove_repeats(docs: DataFrame, filter_bits: int = FILTER_BITS, segment: int = SEGMENT, tries: int = 3) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text): what stays when every repeated passage is removed."""
    keyed = _keyed(docs)
    for seed in range(1, tries + 1):
        with Scratch(docs.sparkSession):
            found = spans(keyed, seed, filter_bits, segment)
            own = found.select(*DOC, "a", "n", F.lit(True).alias("own"))
            sources = found.select(*(F.col(f"src_{c}").alias(c) for c in [*DOC, "a"]), "n", F.lit(False).alias("own")).distinct()
            asked = own.union(sources).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("a", "n", "own"))).alias("asked"))  # one document's spans
            asked = stored(asked)
            copies = keyed.groupBy(*DOC).count().where("count > 1").select(*DOC)
            wanted = _filter(asked.select(*DOC).union(copies), DOC, filter_bits)
            cut = small_batches(_texts(keyed, asked, wanted)).mapInArrow(trimmed(_cut), "doc_id long, d long, t1 long, t2 long, copies long, n_words long, n_removed long, kept_sha256 string, found array<struct<a:long,n:long,own:boolean,digest:binary>>")
            cut = stored(cut, keep=True)
            digests = cut.select(*DOC, F.explode("found").alias("f")).select(*DOC, "f.*")
            here = digests.where("own").drop("own").withColumnRenamed("digest", "here")
            there = digests.where("not own").drop("own").select(*(F.col(c).alias(f"src_{c}") for c in [*DOC, "a"]), "n", F.col("digest").alias("there"))
            checked = found.join(here, [*DOC, "a", "n"], "left").join(there, [f"src_{c}" for c in [*DOC, "a"]] + ["n"], "left")
            deceived = checked.where(~F.col("here").eqNullSafe(F.col("there")) | F.col("here").isNull()).limit(1).count()
        if not deceived:
            break
    else:
        raise RuntimeError("spans differ from their sources, whatever the hashes")
    rows = cut.select("doc_id", "n_words", "n_removed", "kept_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    gone = (F.col("copy") > 1) & (F.col("n_words") >= K)
    return rows.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))

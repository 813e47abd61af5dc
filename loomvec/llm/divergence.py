"""Source divergence audit: how far apart the vocabularies of a language's sources are, and by which terms.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms that
occur in at least ``least_docs`` of its documents. Every group (a source in a language) and the whole language give
each of the V kept terms the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the group's count over kept terms, and two shares
differ by f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Sources are compared in tiles. The terms of a language are dealt into chunks by a hash, and a group's counts in a
chunk are one packed vector. Groups are dealt into blocks, and vectors are replicated to all tiles of two blocks that their own block is in.
A tile computes the sums of f of its pairs chunk after chunk; a tile's chunks are dealt into stripes, tasks of bounded size whose sums
are added, so neither many groups nor a large vocabulary make a large task.

Counting is done once for each text, in tasks that add up by group and term before anything is shuffled, so a source that
has a third of all documents sends no more than its vocabulary from each task.

Defined results: null text, lang and source count as empty, and an empty lang or source is a group like any other; repeated rows are documents of their own;
texts are read whole, a piece at a time; equal values are ranked by UTF-8 of the item; a group without kept terms has the shares of N = 0; a language that keeps
no terms has pairs of value 0; an empty table gives no rows; other columns, doc_id among them, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomvec.llm._common import blocks, checkpointed, spread, table, trimmed
from loomvec.llm._words import texts_of, word_lists

UNIT = 1_000_000_000
#: Bytes that aren't part of a term become spaces, A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Terms that a counting task holds before it hands them on.
HELD_TERMS = 200_000
#: Terms of a chunk, on average; groups of a block, on average; chunks of a stripe.
CHUNK, BLOCK, STRIPE = 4096, 32, 8


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the texts of a task, added up while they fit."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out() -> pa.RecordBatch:
        keys = [(g, t) for g, c in n.items() for t in c]
        columns = [pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()), pa.array([t.decode() for _, t in keys], pa.string())]
        columns += [pa.array([x[g][t] for g, t in keys], pa.int64()) for x in (n, docs)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in blocks(batch, "text"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts_of(part.column("text"))):
                g, seen = (lang, source), set()
                all_n = n.setdefault(g, Counter())
                before = len(all_n)
                for words in word_lists(text, TERM_BYTES):
                    all_n.update(words)
                    seen.update(words)
                docs.setdefault(g, Counter()).update(seen)
                held += len(all_n) - before
                if held >= HELD_TERMS:
                    yield out()
                    n, docs, held = {}, {}, 0
    if held:
        yield out()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and how many of its documents have it."""
    rows = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")))
    some = rows.mapInArrow(trimmed(_count), "lang string, source string, term string, n long, docs long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)) in decimals, which don't overflow."""
    wide = (n + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + 2 * kept).cast("decimal(19,0)"))


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same in 64-bit integers: a long division by thousands, exact up to 9 * 10^15 occurrences."""
    left, out, d = n + 2, np.zeros(len(n), np.int64), total + 2 * kept
    for _ in range(3):
        q, left = np.divmod(left * 1000, d)
        out = out * 1000 + q
    return 1 + out


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of f over a stripe of chunks, for the pairs of groups of a tile."""
    lang, a, b, _ = (k.as_py() for k in key)
    names = {x: sorted({(r, s) for r, s in zip(rows.column("row").to_pylist(), rows.column("source").to_pylist()) if r == x}) for x in {a, b}}
    left, right = names[a], names[b] if b != a else names[a]
    at = {g: i for i, g in enumerate(left)} | ({g: i for i, g in enumerate(right)} if b != a else {})
    sums = np.zeros((len(left), len(right)), np.int64)
    rows = rows.sort_by("chunk")
    marks = np.flatnonzero(np.r_[True, np.diff(rows.column("chunk").to_numpy()) != 0, True])
    for lo, hi in zip(marks, marks[1:]):  # successive chunks of the vocabulary
        part = rows.slice(lo, hi - lo).to_pydict()
        dense = {x: np.zeros((len(names[x]), part["size"][0]), np.int64) for x in names}
        for r, s, positions, counts, total, kept in zip(*(part[c] for c in ("row", "source", "positions", "counts", "total", "kept"))):
            vector = np.zeros(part["size"][0], np.int64)
            if positions:
                vector[np.asarray(positions, np.int64)] = counts
            dense[r][at[r, s]] = shares(vector, total, kept) if kept else vector
        if part["size"][0]:
            for i, p in enumerate(dense[a]):
                q = dense[b]
                sums[i] += ((p - q) ** 2 // (p + q)).sum(axis=1)
    ones = [(i, j) for i in range(len(left)) for j in range(len(right)) if b != a or i < j]
    made = {"lang": [lang] * len(ones), "source": [left[i][1] for i, _ in ones], "item": [right[j][1] for _, j in ones], "value": [int(sums[i, j]) for i, j in ones]}
    return pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in made.items()})


def pair_sums(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two groups of a language, once.

    ``groups``: lang, source, total, kept (N and V); ``kept``: lang, source, term, n of kept terms. One hash deals terms into chunks, so vectors of all groups agree.
    """
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.max("kept").alias("kept"))
    per_lang = per_lang.select("lang", F.greatest(F.lit(1), F.ceil(F.col("kept") / CHUNK)).cast("int").alias("n_chunks"), F.ceil(F.col("n_groups") / BLOCK).cast("int").alias("n_blocks"))
    terms = kept.select("lang", "term").distinct().join(per_lang, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("n_chunks")).cast("int"))
    placed = terms.select("lang", "term", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("position"))
    sizes = placed.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    # at most a chunk's terms in a vector
    packed = kept.join(placed, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("position", "n")).alias("v"))
    packed = packed.select("lang", "source", "chunk", F.col("v.position").alias("positions"), F.col("v.n").alias("counts"))
    grid = groups.join(per_lang.drop("kept"), "lang").withColumn("row", F.pmod(F.xxhash64(F.lit(1), "source"), F.col("n_blocks")).cast("int"))
    grid = grid.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    grid = grid.join(packed, ["lang", "source", "chunk"], "left").join(sizes, ["lang", "chunk"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    tiles = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tiles = tiles.select(
        "lang", F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"), F.floor(F.col("chunk") / STRIPE).cast("int").alias("stripe"), "row", "source", "chunk", "size", "positions", "counts", "total", "kept"
    )
    sums = tiles.groupBy("lang", "a", "b", "stripe").applyInArrow(_tile, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance to every other source of its language, and the ``top`` terms it has more of than its language."""
    counted = checkpointed(count_terms(docs))
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = checkpointed(counted.join(of_lang, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    present = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    groups = present.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    groups = checkpointed(groups)  # a row for each group
    once = pair_sums(groups.select("lang", "source", "total", "kept"), kept.select("lang", "source", "term", "n"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = once.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    p, q = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = kept.join(groups, ["lang", "source"]).where("n > 0").select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
lt AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN l USING (lang, term) GROUP BY ALL),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (gt.total + 2 * lt.v) AS p, 1 + 1000000000::HUGEINT * (l.n + 2) // (lt.total + 2 * lt.v) AS q
  FROM g JOIN l USING (lang) JOIN lt USING (lang) JOIN gt USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term
),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

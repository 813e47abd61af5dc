"""SimHash near-duplicates, with pivot distance tables deciding which pairs are looked at.

A text's words (ASCII letters lower-cased, split at ASCII white space) make shingles; each shingle's XXH64 votes on
64 bits, and a bit of the fingerprint is set if over half the shingles set it. Fingerprints that differ in few
bits are linked.

Search: equal fingerprints first become one. Two fingerprints within ``distance`` bits agree wholly in at
least ``segments - distance`` of ``segments`` bit segments, so each is put, once for every choice of that
many segments, into the cell of its bits there; no link can be missed. Cells that hold very many fingerprints are dealt
out as tiles (pairs of slices) over many tasks. Inside a cell every fingerprint has its row of the pivot
table, its distances to many reference fingerprints: a pair whose rows differ by more than ``distance`` in
any coordinate can't be close (triangle inequality) and is discarded; only survivors are compared bit by bit.
A cell hands on a spanning forest of its links, never all pairs.

``deduplicate`` joins texts whose sets of five-word shingles have a Jaccard similarity of LEAST, 0.8, or more. Fingerprints alone can't
tell that: at 0.8 two fingerprints of 256 bits differ in about 39 bits, give or take 6, and at so wide a distance no bit segments are left that must
agree. So texts meet in cells of equal minima (of every band, the smallest hashes of the set under ROWS random
orders; of texts at exactly 0.8 one pair in 30 million shares none of the BANDS cells, of texts more alike fewer). In a
cell a pair goes on unless the sizes of the sets or their 256-bit SimHash fingerprints rule it out: BIT_LIMIT is more than five standard deviations above what 0.8
gives. Here too a pivot table decides which pairs are looked at: at so wide a limit fixed pivots are all equally far and tell nothing apart, so a cell's pivots are
fingerprints of its own, far from each other; a pair whose rows of the table differ by more than BIT_LIMIT is discarded unseen, which loses no link. A cell hands on only which texts have to be looked at together; each such block then compares the whole sets of shingle
hashes (64 bits), every pair that its own, exact shingle counts don't rule out and that isn't joined already, and
hands on the pairs that hold. Blocks and cells too large for a task are dealt out as tiles.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words
than a shingle make one shingle; a component's id is the smallest non-null doc_id in it (null if there is none).
Very long texts count with all their shingles, in bounded lists. Repeated rows stay repeated in ``components``, all with the same
component; ``deduplicate`` keeps one row of a group: that with the smallest id, of equal ids the smallest hash of the text, and of
rows that share both the one whose columns have the smallest hash. Empty tables give no rows. Extra columns are ignored by
``components`` and kept by ``deduplicate``. Sets are told apart by a 64-bit hash: n of them hold a collision with a probability of n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm._common import blocks, checkpointed, small_batches, spread, trimmed
from loomvec.llm.components import connected_components

SEED = 42
#: Shingles whose votes are held at once.
VOTES = 1 << 17
#: Fingerprints of a cell above which it is dealt out as tiles.
TILE = 4096
#: Reference fingerprints of the pivot table.
N_PIVOTS = 32
#: The similarity from which texts are near copies, as a fraction.
LEAST = (4, 5)
#: Bands of a text and minima of a band.
BANDS, ROWS = 24, 3
#: Bits in which the 256-bit fingerprints of texts alike enough may differ.
LANES, BIT_LIMIT = 4, 84
#: Pivots that a cell of texts chooses from its own fingerprints.
CELL_PIVOTS = 8
#: One of so many cells is counted to find crowded ones.
CELL_SAMPLE = 64
#: Shingle hashes of a block above which it is dealt out as tiles, and those that are compared at once.
BLOCK_HASHES, AT_ONCE = 1 << 20, 1 << 20
#: Rows (of some 60 bytes) up to which a list of texts is broadcast to where the texts are; a longer one is joined by a shuffle.
LIST_ROWS = 1 << 18


def shingles(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The text's shingles, in bounded lists."""
    words = text.lower().split()
    if not words:
        return
    if len(words) < width:
        yield [b" ".join(words)]
        return
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    ends = ends[width - 1 :]
    for at in range(0, len(starts), VOTES):
        yield [flat[a:b] for a, b in zip(starts[at : at + VOTES].tolist(), ends[at : at + VOTES].tolist(), strict=True)]


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The distinct values, in order."""
    return np.unique(hashes)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, each given as distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The text's distinct shingle hashes, in order."""
    return smallest(np.array([xxhash.xxh64_intdigest(s, SEED) for part in shingles(text or b"", width) for s in part], np.uint64))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of ``n`` have one in common with those of any set that is alike enough."""
    a, b = LEAST
    return n - (a * n + b - 1) // b + 1


def common_least(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The shingles that sets of ``n`` and ``m`` must have in common to be alike enough."""
    a, b = LEAST
    return (a * (n + m) + a + b - 1) // (a + b)


def fingerprints(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """(texts, 1) uint64 fingerprints."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def vote() -> None:
        if hashes:
            counts = np.array([n for _, n in owners])
            who, at = np.array([i for i, _ in owners]), np.concatenate([[0], np.cumsum(counts)[:-1]])
            h = np.array(hashes, np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, who, np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            np.add.at(total, who, counts)
            hashes.clear()
            owners.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        for part in shingles(text or b"", width):
            hashes.extend([digest(s, SEED) for s in part])
            owners.append((i, len(part)))
            if len(hashes) >= VOTES:
                vote()
    vote()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(texts), 1)


def fingerprint_table(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_key, fp) of every row: ``text_key`` is a hash of its text, ``fp`` the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                fp = fingerprints(b.column("text").to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "fp": pa.array(np.ascontiguousarray(fp[:, 0]))})

    raw = small_batches(spread(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(trimmed(run), "doc_id long, text_key long, fp long")


def segment_masks(distance: int, segments: int) -> list[tuple[int]]:
    """Masks of which at least one leaves any two fingerprints within ``distance`` bits equal."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(segments)]
    return [(sum(c),) for c in combinations(parts, segments - distance)]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random values."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def close_pairs(fp: np.ndarray, run: np.ndarray, side: np.ndarray, limit: int, pivot_limit: int, reference: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of one run (``run`` is sorted) whose (n, lanes) fingerprints differ in at most ``limit`` bits, and those bits' number.

    ``side``: 0 compares with every row of the run; 1 and 2 compare only with each other. Pairs whose distances to
    a reference fingerprint differ by more than ``pivot_limit`` are discarded unseen.
    """
    n = len(fp)
    pivot_table = np.bitwise_count(fp[:, :1] ^ reference[None, :]).astype(np.int8)
    last = np.searchsorted(run, run, side="right")
    active = np.arange(n)
    k = 0
    while True:
        k += 1
        active = active[active + k < last[active]]
        if not len(active):
            return
        i, j = active, active + k
        if side.any():
            cross = (side[i] != side[j]) | (side[i] == 0)
            i, j = i[cross], j[cross]
        for at in range(0, len(reference), 4):  # most pairs fail at the first pivots
            if not len(i):
                break
            ok = (np.abs(pivot_table[i, at : at + 4] - pivot_table[j, at : at + 4]) <= pivot_limit).all(axis=1)
            i, j = i[ok], j[ok]
        if len(i):
            bits = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int32)
            ok = bits <= limit
            if ok.any():
                yield i[ok], j[ok], bits[ok]


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels until both ends of every pair have the same one."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label[:] = label[label]


def nearest_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the pairs (i, j, bits) between ``n`` nodes, holding about ``most`` of them at once."""

    def reduced(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bits, kind="stable")
        i, j, bits = i[order], j[order], bits[order]
        label, chosen, alive = np.arange(n), np.zeros(len(i), bool), np.arange(len(i))
        while True:  # every tree takes its first pair that leads out of it; the order has no ties, so that closes no circle
            a, b = label[i[alive]], label[j[alive]]
            out = a != b
            a, b, alive = a[out], b[out], alive[out]
            if not len(alive):
                return i[chosen], j[chosen], bits[chosen]
            first = np.full(n, len(i))
            np.minimum.at(first, a, alive)
            np.minimum.at(first, b, alive)
            taken = np.unique(first[first < len(i)])
            chosen[taken] = True
            settle(label, i[taken], j[taken])

    none = np.zeros(0, np.int64)
    held, size = [(none, none, none)], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= most:
            held, size = [reduced(held)], 0
    return reduced(held)


def links(fps: DataFrame, masks: list[tuple[int, ...]], limit: int, pivot_limit: int, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Links (u, v, bits) between distinct ``fp`` within ``limit`` bits that share a cell: of every cell, a minimum spanning forest."""
    lanes = ["fp", "l1", "l2", "l3"][: len(masks[0])]
    signed = lambda m: F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(signed(m)) for c, m in zip(lanes, mask, strict=True) if m]) for t, mask in enumerate(masks)]
    cells = fps.select(*lanes, F.explode(F.array(*keys)).alias("key"))
    crowded = cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).cast("int").alias("slices"))
    cells = cells.join(crowded, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    tiles = cells.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")).select(
        *lanes, "key", "mine", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    ).select(*lanes, F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"))
    # of equally near pairs the first ones are taken, so the order inside a cell must not depend on how rows arrive
    ordered = tiles.repartition("cell").sortWithinPartitions("cell", *lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots(n_pivots)
        held = (np.zeros(0, np.int64), np.zeros((0, len(lanes)), np.uint64), np.zeros(0, np.int8))

        def find(cell: np.ndarray, fp: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(cell) > 1:
                i, j, bits = nearest_forest(len(fp), close_pairs(fp, cell, side, limit, pivot_limit, reference))
                if len(i):
                    s = np.ascontiguousarray(fp[:, 0]).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(s[i], s[j])), "v": pa.array(np.minimum(s[i], s[j])), "bits": pa.array(bits.astype(np.int32))})

        for b in batches:
            of = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            new = (of("cell"), np.stack([of(c) for c in lanes], axis=1).view(np.uint64), of("side"))
            cell, fp, side = (np.concatenate([a, c]) for a, c in zip(held, new, strict=True))
            if not len(cell):
                continue
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            yield from find(cell[:whole], fp[:whole], side[:whole])
            held = (cell[whole:], fp[whole:], side[whole:])
        yield from find(*held)

    return ordered.mapInArrow(trimmed(run), "u long, v long, bits int")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes under the ``k``-th of a family of bijections."""
    odd = np.uint64(xxhash.xxh64_intdigest(f"odd {k}".encode(), SEED) | 1)
    h = (h ^ np.uint64(xxhash.xxh64_intdigest(f"flip {k}".encode(), SEED))) * odd
    return (h ^ (h >> np.uint64(32))) * odd


def minima(h: np.ndarray, flips: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The smallest hash of a set that isn't empty, under each of len(flips) orders."""
    out = np.full(len(flips), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        part = h[None, at : at + 4096] ^ flips[:, None]
        part *= odds[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def set_fingerprint(h: np.ndarray) -> np.ndarray:
    """LANES x 64 bits, each set if over half of the shingle hashes, under a bijection for each lane, set it."""
    out = np.zeros(LANES, np.uint64)
    for lane in range(LANES):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            m = mixed(h[at : at + (1 << 14)], lane)
            bits = np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            ones += bits[whole:].sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def signature_table(raw: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, fp, n, lanes, keys) of every row: ``fp`` stands for its set of shingles, ``n`` is their number, ``lanes`` has
    the fingerprint and ``keys`` the cells that the text is put into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, odds = (np.array([xxhash.xxh64_intdigest(f"{kind} {k}".encode(), SEED) for k in range(BANDS * ROWS)], np.uint64) for kind in ("order", "factor"))
        odds |= np.uint64(1)
        for batch in batches:
            for b in blocks(batch, "text"):
                out: dict[str, list] = {c: [] for c in ("fp", "n", "lanes", "keys")}
                for t in b.column("text").to_pylist():
                    h = shingle_set(t, width)
                    keys = []
                    if len(h):
                        low = minima(h, flips, odds).reshape(BANDS, ROWS)
                        keys = np.frombuffer(b"".join(xxhash.xxh64_digest(low[k].tobytes() + bytes([k]), SEED) for k in range(BANDS)), np.int64).tolist()
                    for c, v in zip(out, (xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), set_fingerprint(h).view(np.int64).tolist(), keys), strict=True):
                        out[c].append(v)
                fp = pa.array(np.array(out["fp"], np.uint64).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "fp": fp, "n": pa.array(out["n"], pa.int32()), "lanes": pa.array(out["lanes"], longs), "keys": pa.array(out["keys"], longs)})

    return raw.mapInArrow(trimmed(run), "doc_id long, text_key long, fp long, n int, lanes array<long>, keys array<long>")


def dealt(cells: DataFrame, by: str) -> DataFrame:
    """``cells`` (``by``, fp, slices, ...) with ``cell`` and ``side``: ``slices`` slices each, every pair of them a cell."""
    mine = cells.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("byte")
    return mine.withColumn("cell", F.xxhash64(by, F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", side).drop(by, "slices", "mine", "other")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``cell``, cut anew so that no cell goes on in the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cell = b.column("cell").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        if held and held[-1].column("cell")[-1].as_py() != cell[0] if len(cell) else False:
            yield pa.concat_batches(held)
            held = []
        if len(cuts):
            yield pa.concat_batches([*held, b.slice(0, int(cuts[-1]))])
            held, b = [], b.slice(int(cuts[-1]))
        if len(b):
            held.append(b)
    if held:
        yield pa.concat_batches(held)


def cross(side: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    return (side[i] != side[j]) | (side[i] == 0)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the rows' fingerprints, (n, lanes), differ."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def own_pivots(first: np.ndarray, of: np.ndarray, lanes: np.ndarray, n_pivots: int = CELL_PIVOTS) -> np.ndarray:
    """(n, n_pivots): distances of every row to the pivots of its cell, which are rows of it: the first one, then each time the one farthest from those before.

    ``first``: where each cell begins; ``of``: the cell of each row.
    """
    total = len(lanes)
    table, at, back = np.empty((total, n_pivots), np.int16), first, np.arange(total)[::-1]
    for k in range(n_pivots):
        table[:, k] = bits_apart(lanes, lanes[at][of])
        far = table[:, : k + 1].min(axis=1).astype(np.int64)
        at = total - 1 - np.maximum.reduceat(far * total + back, first) % total  # of rows equally far the first
    return table


def candidate_forest(cell: np.ndarray, n: np.ndarray, lanes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join the rows of a cell just as those do that the sizes ``n`` (rising in a cell) and the fingerprints allow."""
    total = len(cell)
    label, last = np.arange(total), np.searchsorted(cell, cell, side="right")
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, total)))
    active, k, a, b = np.arange(total), 0, LEAST[0], LEAST[1]
    table = own_pivots(first, of, lanes)
    while True:
        k += 1
        active = active[active + k < last[active]]
        active = active[b * n[active] >= a * n[active + k]]  # the next ones are larger still
        if not k & (k - 1):  # cells that are joined already need no more looks
            one = np.minimum.reduceat(label, first) == np.maximum.reduceat(label, first)
            active = active[~one[of[active]]]
        if not len(active):
            break
        i, j = active, active + k
        ok = (label[i] != label[j]) & cross(side, i, j)
        i, j = i[ok], j[ok]
        ok = (np.abs(table[i] - table[j]) <= BIT_LIMIT).all(axis=1)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        ok = bits_apart(lanes[i], lanes[j]) <= BIT_LIMIT
        if ok.any():
            settle(label, i[ok], j[ok])
    moved = np.flatnonzero(label != np.arange(total))
    return moved, label[moved]


def candidates(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct ``fp`` whose components hold the pairs that are alike enough (and others)."""
    cells = fps.select("fp", "n", "lanes", F.explode("keys").alias("key"))
    # cells have the same share of crowded ones at every size, and a text is in BANDS cells, so a count of some of the keys' texts tells how
    # crowded a cell is: it decides how much work goes to a task, never the result
    counted = cells.where(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(CELL_SAMPLE)) == 0).groupBy("key").agg((CELL_SAMPLE * F.count("*")).alias("rows"))
    crowded = counted.where(F.col("rows") > TILE).select("key", F.ceil(F.col("rows") / TILE).cast("int").alias("slices"))
    # at most one row for every TILE of cells, so it may be broadcast
    cells = dealt(cells.join(F.broadcast(crowded), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1))), "key")
    parts = [F.get("lanes", F.lit(k)).alias(f"l{k}") for k in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_cells(batches):
            cell, n, side, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "side", "fp"))
            lanes = np.stack([b.column(f"l{k}").to_numpy(zero_copy_only=False) for k in range(LANES)], axis=1).view(np.uint64)
            i, j = candidate_forest(cell, n.astype(np.int64), lanes, side)
            if len(i):
                yield pa.RecordBatch.from_pydict({"u": pa.array(fp[i]), "v": pa.array(fp[j])})

    return cells.select("fp", "n", "cell", "side", *parts).repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(trimmed(run), "u long, v long")


def alike(sets: list[np.ndarray], side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) alike enough, which join the sets (not both of one side 1 or 2) just as all such pairs do."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    side, n = side[order], np.array([len(sets[k]) for k in order])
    own, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    _, flat, counts = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare ones first
    flat = rank[flat]
    flat = flat[np.lexsort((flat, own))]
    at = np.arange(len(flat)) - starts[own]
    first = np.flatnonzero(at < prefix_length(n)[own])
    first = first[np.argsort(flat[first], kind="stable")]  # of each shingle, its sets from small to large
    node, place, last = own[first], at[first], np.searchsorted(flat[first], flat[first], side="right")
    useful = np.flatnonzero(last > np.arange(len(first)) + 1)
    useful = useful[np.argsort(node[useful], kind="stable")]
    bounds = np.searchsorted(node[useful], np.arange(len(n) + 1))
    label, mark = np.arange(len(n)), np.zeros(len(counts), bool)
    spread = lambda start, size: np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        e = useful[bounds[i] : bounds[i + 1]]
        size = last[e] - e - 1
        found = spread(e + 1, size)
        j = node[found]
        ok = (np.minimum(n[i] - np.repeat(place[e], size), n[j] - place[found]) >= common_least(n[i], n[j])) & (label[j] != label[i])
        j = np.unique(j[ok])
        j = j[(LEAST[1] * n[i] >= LEAST[0] * n[j]) & cross(side, i, j)]
        if not len(j):
            continue
        mine = flat[starts[i] : starts[i] + n[i]]
        mark[mine] = True
        part = np.cumsum(n[j]) // AT_ONCE
        for k in np.unique(part):
            js = j[part == k]
            both = np.add.reduceat(mark[flat[spread(starts[js], n[js])]], np.cumsum(n[js]) - n[js], dtype=np.int64)
            js = js[both >= common_least(n[i], n[js])]
            if len(js):
                yield from ((int(order[i]), int(order[x])) for x in js.tolist())
                settle(label, np.full(len(js), i), js)
        mark[mine] = False


def beside(texts: DataFrame, chosen: DataFrame, how: str = "inner") -> DataFrame:
    """``texts`` (doc_id, text_key, ...) joined with ``chosen`` (the_id, the_key, ...; materialised): texts stay where they are if ``chosen`` is short."""
    same = F.col("doc_id").eqNullSafe(F.col("the_id")) & (F.col("text_key") == F.col("the_key"))
    return texts.join(F.broadcast(chosen) if chosen.count() <= LIST_ROWS else chosen, same, how)


def confirmed(found: DataFrame, fps: DataFrame, raw: DataFrame, width: int) -> DataFrame:
    """Links (u, v) that join just as all pairs alike enough do, inside the components of ``found``."""
    member = connected_components(found).join(fps.select(F.col("fp").alias("node"), "n", "one_id", "one_key"), "node")
    member = checkpointed(member.select(F.col("node").alias("fp"), "component", "n", F.col("one_id").alias("the_id"), F.col("one_key").alias("the_key")))
    # components and blocks of many hashes are few, at most one for every BLOCK_HASHES of all, so those may be broadcast
    big = member.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") > BLOCK_HASHES).select("component", F.lit(True).alias("big"))
    # a big component is cut by size: sets alike enough differ by a factor of 1.25 at most, so by one level
    level = F.floor(F.log(F.col("n")) / math.log(1.26)).cast("int")
    member = member.join(F.broadcast(big), "component", "left").withColumn("level", F.explode(F.when(F.col("big"), F.array(level - 1, level)).otherwise(F.array(F.lit(-9)))))
    member = member.withColumn("block", F.xxhash64("component", "level"))
    crowded = member.groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_HASHES).select("block", F.ceil(F.col("n") / BLOCK_HASHES).cast("int").alias("slices"))
    member = member.join(F.broadcast(crowded), "block", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    member = checkpointed(member.groupBy("the_id", "the_key").agg(F.min("fp").alias("fp"), F.collect_set(F.struct("block", "slices")).alias("blocks")))  # two blocks at most
    # one row of each set; rows with the same id and text come more than once, which does no harm
    texts = beside(raw, member).select("fp", F.explode("blocks").alias("b"), "text").select("fp", "b.block", "b.slices", "text")
    tiles = dealt(texts, "block").repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def find(fp: list[int], side: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = list(alike(sets, np.array(side))) if len(fp) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_pydict({"u": pa.array([fp[i] for i, _ in pairs], pa.int64()), "v": pa.array([fp[j] for _, j in pairs], pa.int64())})

        now, fp, side, sets = None, [], [], []
        for b in batches:
            for cell, one, where, text in zip(*(b.column(c) for c in ("cell", "fp", "side", "text")), strict=True):
                if cell.as_py() != now:
                    yield from find(fp, side, sets)
                    now, fp, side, sets = cell.as_py(), [], [], []
                if not fp or fp[-1] != one.as_py():
                    fp.append(one.as_py())
                    side.append(where.as_py())
                    sets.append(shingle_set(text.as_py(), width))
        yield from find(fp, side, sets)

    return small_batches(tiles).mapInArrow(trimmed(run), "u long, v long")


def grouped(thin: DataFrame, fps: DataFrame, linked: DataFrame) -> DataFrame:
    """``thin`` (a fingerprint table) with ``component``, which stands for the group even without ids, and ``component_id``.

    ``fps``: its distinct ``fp`` with their smallest ids; ``linked``: links (u, v) between those.
    """
    member = connected_components(linked)
    named = fps.select("fp", "first_id").join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("fp", "component", "component_id")
    return thin.select("doc_id", "text_key", "fp").join(named, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def components(docs: DataFrame, width: int = 4, distance: int = 4, segments: int = 6) -> DataFrame:
    """(doc_id, text_key, fp, component, component_id) of every row, linking exactly the fingerprints within ``distance`` bits."""
    thin = checkpointed(fingerprint_table(docs, width))
    fps = thin.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    return grouped(thin, fps, links(fps.select("fp"), segment_masks(distance, segments), distance, distance))


def near_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text_key, fp, component, component_id) of every row, linking the texts of similarity 0.8 or more; ``fp`` stands for the set of shingles."""
    raw = small_batches(spread(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    thin = checkpointed(signature_table(raw, width))
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    fps = thin.groupBy("fp").agg(F.min("doc_id").alias("first_id"), one, *[F.first(c).alias(c) for c in ("n", "lanes", "keys")])
    fps = checkpointed(fps.select("fp", "first_id", F.col("one.doc_id").alias("one_id"), F.col("one.text_key").alias("one_key"), "n", "lanes", "keys"))
    return grouped(thin, fps, confirmed(candidates(fps), fps, raw, width))


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (of repeated rows, one)."""
    thin = near_groups(docs, width)
    rows = checkpointed(thin.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n")))  # repeated rows as one
    # a group's keeper: smallest id, then smallest text hash
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("b"), F.count("*").alias("members"))
    best = best.where("members > 1").select("component", F.col("b.doc_id").alias("keep_id"), F.col("b.text_key").alias("keep_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    gone = checkpointed(rows.join(best, "component").where(~kept).select(F.col("doc_id").alias("the_id"), F.col("text_key").alias("the_key")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = beside(keyed, gone, "left_anti")
    if rows.where("n > 1").limit(1).count():
        ordered = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        # combined before it is shuffled, so a row repeated very often is no bottleneck
        left = left.groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64(*ordered)).alias("row"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return deduplicate(docs)

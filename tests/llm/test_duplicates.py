"""SimHash, components and winnowing against plain versions."""

import functools
import hashlib

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.llm import simhash, winnowing
from loomvec.llm.components import connected_components


def plain_fingerprint(text, width=4):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, distance):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x == max(a, b) else x for x in label]
    return {d: min(e for e, m in zip(ids, label) if m == label[k]) for k, d in enumerate(ids)}


def test_whole_table_equals_brute_force(spark, sf_dir, docs):
    got = simhash.query(spark, sf_dir).toPandas().set_index("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert all(got.fingerprint[d] == f"{f:016x}" for d, f in zip(docs.doc_id, fps))
    assert got.component_id.to_dict() == groups(docs.doc_id.tolist(), np.array(fps, np.uint64), 4)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB \t é\n", max_size=40))
def test_fingerprint_of_any_text(text):
    assert int(simhash.fingerprints([text.encode()])[0, 0]) == plain_fingerprint(text)


@pytest.mark.parametrize("tile", [4096, 7])
def test_links_lose_nothing_in_crowded_cells(spark, monkeypatch, tile):
    """Near copies all in few cells, which small tiles deal over many tasks."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = []
    for b in base:
        for _ in range(25):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << bit
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = connected_components(simhash.links(df, simhash.segment_masks(4, 6), 4, 4)).toPandas()
    got = dict(zip(found.node, found.component))
    want = groups(fps.view(np.int64).tolist(), fps, 4)
    assert {f: got.get(f, f) for f in want} == want


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {k: 100 for k in range(100, 161)}


def test_deduplicate_keeps_one_of_each_group(spark, odd_docs):
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, k = [], 0
    for g in range(12):
        base = words(300)
        for c in range(4):
            own = list(base)
            for i in rng.choice(300, c, replace=False):
                own[i] = "changed"
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(k + i, " ".join(words(200))) for i in range(30)]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {4 * g for g in range(12)} | set(range(48, 78))
    odd = simhash.deduplicate(odd_docs).toPandas()
    assert sorted(odd.doc_id.dropna()) == [1, 2, 5, 7, 8, 9, 10, 11, 11] and odd.doc_id.isna().sum() == 1


def test_texts_that_share_a_repeated_line_both_stay(spark):
    """Every bit of the fingerprints is that line's; the sets of shingles are alike at 0.03."""
    rng = np.random.default_rng(2)
    line = "all rights reserved by the owner of this page "
    texts = [line * 100 + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 80)) for _ in range(2)]
    got = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1]


@pytest.mark.parametrize("rows", [1 << 18, 0])
def test_which_row_stays_is_fixed(spark, monkeypatch, rows):
    """With lists short enough to broadcast, and with the joins that longer ones take."""
    monkeypatch.setattr(simhash, "LIST_ROWS", rows)
    rows = [(3, "one and the same text that is here three times over", "x"), (3, "one and the same text that is here three times over", "y"), (3, "one and the same text that is here three times over", "y"), (None, "one and the same text that is here three times over", "z"), (None, None, "n"), (9, "", "e")]
    one, two = (sorted(map(tuple, simhash.deduplicate(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect()), key=repr) for r in (rows, rows[::-1]))
    assert one == two and len(one) == 2 and [r[0] for r in one].count(3) == 1 and [r[0] for r in one].count(9) == 1


def test_large_groups_of_near_copies_take_few_looks():
    """A cell whose texts are joined already isn't gone through to the last pair."""
    rng = np.random.default_rng(0)
    lanes = np.repeat(rng.integers(0, 1 << 62, (1, 4), dtype=np.uint64), 4000, axis=0)
    i, j = simhash.candidate_forest(np.zeros(4000, np.int64), np.full(4000, 300), lanes, np.zeros(4000, np.int8))
    assert len(i) == 3999 and set(j.tolist()) == {0}


def clustered(rng, sizes):
    """256-bit fingerprints of clusters: some 10 bits about a centre; the centres have nothing to do with each other."""
    bits = np.concatenate([rng.integers(0, 2, (1, 256)) ^ (rng.random((n, 256)) < 0.04) for n in sizes]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def test_pivots_decide_which_texts_of_a_cell_are_looked_at(monkeypatch):
    """Of texts in two clusters that share a cell no pair across is compared, and each cluster is joined as by all pairs."""
    rng, looked = np.random.default_rng(5), []
    lanes = clustered(rng, [200, 200])[rng.permutation(400)]
    table = simhash.own_pivots(np.array([0]), np.zeros(400, np.int64), lanes)
    real = simhash.bits_apart
    monkeypatch.setattr(simhash, "own_pivots", lambda *_: table)
    monkeypatch.setattr(simhash, "bits_apart", lambda a, b: looked.append(real(a, b)) or looked[-1])
    i, j = simhash.candidate_forest(np.zeros(400, np.int64), np.full(400, 300), lanes, np.zeros(400, np.int8))
    assert (np.concatenate(looked) <= simhash.BIT_LIMIT).all() and len(i) == 398 and len(set(j.tolist())) == 2


def test_pivots_of_a_cell_lose_no_link():
    """Cells of clusters at all distances about the limit, against all pairs."""
    rng = np.random.default_rng(6)
    for noise in (0.02, 0.1, 0.17, 0.2, 0.3):
        centre = rng.integers(0, 2, (40, 256))
        bits = (centre[rng.integers(0, 4, 150)] ^ (rng.random((150, 256)) < noise)).astype(np.uint8)
        lanes, cell = np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.sort(rng.integers(0, 5, 150))
        i, j = simhash.candidate_forest(cell, np.full(150, 300), lanes, np.zeros(150, np.int8))
        got, want = np.arange(150), np.arange(150)
        simhash.settle(got, i, j)
        a, b = np.triu_indices(150, 1)
        near = (cell[a] == cell[b]) & (np.bitwise_count(lanes[a] ^ lanes[b]).sum(axis=1) <= simhash.BIT_LIMIT)
        simhash.settle(want, a[near], b[near])
        assert (got == want).all()


def five_word_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_groups_hold_the_pairs_at_four_fifths(spark, sf_dir, docs):
    """Over all pairs of the table."""
    got = simhash.near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().set_index("doc_id").component_id
    sets = {}
    for d, t in zip(docs.doc_id, docs.text):
        sets.setdefault(frozenset(five_word_shingles(t)), []).append(d)
    some = [s for s in sets if s]
    label = alike_groups(some)
    first = {}
    for k, s in enumerate(some):
        first[label[k]] = min(first.get(label[k], 1 << 60), min(sets[s]))
    want = {d: first[label[k]] for k, s in enumerate(some) for d in sets[s]} | {d: min(x) for s, x in sets.items() if not s for d in x}
    assert got.to_dict() == want and got.duplicated().any()


def test_near_groups_do_not_depend_on_the_order_of_rows(spark, docs):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text)]
    for k in range(120):  # many ties among near copies, about the limit
        own = list(base)
        for i in rng.choice(300, int(rng.integers(0, 9)), replace=False):
            own[i] = f"x{k}"
        rows.append((10_000 + k, " ".join(own)))
    one, other = (
        {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(x, "doc_id long, text string").repartition(n)).collect()}
        for x, n in ((rows, 3), (rows[::-1], 7))
    )
    assert one == other


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=128), st.sets(st.integers(0, 400), max_size=128))
def test_similarity_of_small_sketches_is_exact(a, b):
    got = simhash.similarity(*(simhash.smallest(np.array(sorted(x), np.uint32)) for x in (a, b)))
    assert got == (len(a & b) / len(a | b) if a | b else 1.0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 5)).filter(lambda p: p[0] != p[1]), max_size=40), st.integers(1, 50))
def test_nearest_forest_joins_what_each_limit_joins(pairs, most):
    def joined(edges):
        label = list(range(10))
        for i, j in edges:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        return label

    given_ = [(np.array([i]), np.array([j]), np.array([n])) for i, j, n in pairs]
    found = list(zip(*(x.tolist() for x in simhash.nearest_forest(10, iter(given_), most)), strict=True))
    for limit in range(6):
        assert joined((i, j) for i, j, n in found if n <= limit) == joined((i, j) for i, j, n in pairs if n <= limit)
    assert len(found) < 10


UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
PLAIN_TOKEN = regex.compile(rf"(?V1)[{UNSPACED}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{UNSPACED}]]{{1,32}}|[^\s\p{{L}}\p{{M}}\p{{N}}]")


def plain_winnow(text):
    """(position, hash) of the selected grams: every window looked at by itself."""

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def both(a, b):
        return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))

    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in PLAIN_TOKEN.findall(text.lower())]
    grams = [both(both(a, b), both(c, d)) for a, b, c, d in zip(tokens, tokens[1:], tokens[2:], tokens[3:])]
    if 0 < len(tokens) < 4:
        grams = [functools.reduce(both, tokens, 42)]
    windows = [range(i, i + 4) for i in range(len(grams) - 3)] or [range(len(grams))] * (len(grams) > 0)
    return sorted({min(w, key=lambda i: (grams[i] >> winnowing.POSITION_BITS, -i)) for w in windows}), grams


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_selection_is_the_rightmost_minimum_of_each_window(spark):
    text = "a b a b a b a b c d e f g h i j k l a b a b a b"
    row = winnowing.fingerprint(spark.createDataFrame([(text,)], "text string"), out="f").first()
    grams = winnowing.select(spark.createDataFrame([(" ".join(text.split()[i : i + 4]),) for i in range(21)], "text string"), "text", "s").select(winnowing.hashes("s")[0].alias("h")).collect()
    h = [g["h"] for g in grams]
    want = []
    for at in range(len(h) - 3):
        i = max(i for i in range(at, at + 4) if h[i] == min(h[at : at + 4]))
        if i not in want:
            want.append(i)
    assert [p["position"] for p in row["f"]] == want and [p["hash"] for p in row["f"]] == [h[i] for i in want]


def test_shared_passages_are_found(spark):
    shared = "seven tokens that both texts have here"
    df = spark.createDataFrame([(f"one two three {shared} four", f"x {shared} y z")], "a string, b string")
    df = winnowing.select(winnowing.select(df, "a", "s"), "b", "t")
    assert df.select(F.size(F.array_intersect(winnowing.hashes("s"), winnowing.hashes("t"))).alias("n")).first()["n"] >= 1


def test_whole_query_equals_plain_winnowing(spark, sf_dir, docs):
    got = winnowing.query(spark, sf_dir).toPandas().set_index("doc_id")
    x = docs.sort_values("doc_id", ascending=False)

    def chosen(text):
        at, grams = plain_winnow(text)
        return hashlib.sha256("|".join(",".join(map(str, x)) for x in (at, [grams[i] for i in at])).encode()).hexdigest(), {grams[i] for i in at}

    for d, t, after in zip(x.doc_id, x.text, [*x.text[1:], x.text.iloc[0]]):
        half = len(t) // 2
        (own, mine), (edited, theirs), (_, following) = chosen(t), chosen(t[: len(t) - half] + after[:half]), chosen(after)
        row = got.loc[d]
        assert (row.fingerprint, row.edited_fingerprint) == (own, edited)
        assert abs(row.near_edited - plain_likeness(mine, theirs)) < 1e-12 and abs(row.near_next - plain_likeness(mine, following)) < 1e-12


def test_edited_texts_and_successors(spark, sf_dir, docs):
    got = winnowing.query(spark, sf_dir).toPandas().set_index("doc_id")
    x = docs.sort_values("doc_id", ascending=False)
    after = dict(zip(x.doc_id, [*x.text[1:], x.text.iloc[0]]))
    for d, t in zip(x.doc_id, x.text):
        half = len(t) // 2
        assert got.edited_sha256[d] == hashlib.sha256((t[: len(t) - half] + after[d][:half]).encode()).hexdigest() and got.n_chars[d] == len(t)
    by_text = x.assign(f=[got.fingerprint[d] for d in x.doc_id]).groupby("text").f.nunique()
    assert by_text.max() == 1 and got.near_edited.between(0, 1).all() and got.near_edited.mean() > 5 * got.near_next.mean()


def successors(df, **how):
    w = winnowing.Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text_key", F.col("copies").desc())
    rows = winnowing.in_order(df, **how).withColumn("n", F.lead(F.struct("doc_id", "text")).over(w)).where("not guest").collect()
    return sorted((str(r["doc_id"]), r["text"], str(r["n"]["doc_id"]), r["n"]["text"]) for r in rows)


def test_buckets_do_not_change_successors(spark, docs):
    df = spark.createDataFrame(docs[["doc_id", "text"]])
    a, b = (winnowing.in_order(df, rows_per_bucket=n) for n in (7, 10_000))
    assert a.where("guest").count() > 20 and b.where("guest").count() == 1
    assert successors(df, rows_per_bucket=7) == successors(df, rows_per_bucket=10_000) == successors(df, rows_per_bucket=7, most_buckets=3)


def test_hot_and_null_ids_are_divided(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    ids = [low, low + 1, -5, *[17] * 400, *range(18, 60), *range(10**6, 10**6 + 90), 10**15, high, *[None] * 300]
    df = spark.createDataFrame([(d, f"text {k}") for k, d in enumerate(ids)], "doc_id long, text string")
    key = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    x = sorted(((d, f"text {k}") for k, d in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    want = sorted((str(d), t, str(e), u) for (d, t), (e, u) in zip(x, [*x[1:], x[0]]))
    for ranges in (1, 2, 5, 40, 4096):
        assert successors(df, rows_per_bucket=20, most_buckets=ranges) == want
    sizes = winnowing.in_order(df, rows_per_bucket=20, most_buckets=40).where("not guest").groupBy("bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 60


def test_buckets_follow_ranks(spark):
    """Clustered ids and one far off, and a third of all rows equal: no bucket holds twice its share, and every row has its successor."""
    rows = [(d, f"text {d}") for d in range(1000)] + [(10**15, "far off")] + [(500, "the same row")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = [r["count"] for r in winnowing.in_order(df, rows_per_bucket=10).where("not guest").groupBy("bucket").count().collect()]
    assert sum(sizes) == 1001 + 2 and len(sizes) == 101 and max(sizes) <= 20
    got = winnowing.compare(df).select("doc_id", "text", "edited", "near_next").toPandas()
    few = winnowing.compare(df.repartition(2)).count()
    same = got[got.text == "the same row"]
    assert len(got) == few == 1501 and (same.near_next == 1.0).sum() == 499 and (same.edited == "the same row").sum() <= 499
    from unittest import mock

    want = sorted(map(tuple, got.values))
    with mock.patch.object(winnowing, "in_order", lambda docs, f=winnowing.in_order: f(docs, rows_per_bucket=10)):
        assert sorted(map(tuple, winnowing.compare(df).select("doc_id", "text", "edited", "near_next").toPandas().values)) == want


def alike_groups(sets):
    """Each set's group, named by its smallest index: of a plain comparison of all pairs at a similarity of 0.8."""
    holders, label = {}, list(range(len(sets)))
    for k, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(k)
    holders, size = {s: np.array(x) for s, x in holders.items()}, np.array([len(s) for s in sets])
    for k, own in enumerate(sets):
        both = np.bincount(np.concatenate([holders[s] for s in own]), minlength=len(sets))
        for e in np.flatnonzero(9 * both >= 4 * (size + size[k])).tolist():
            a, b = label[k], label[e]
            if a != b:
                label = [min(a, b) if x == max(a, b) else x for x in label]
    return label


def near_group_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    return [got[k] for k in range(len(texts))]


@pytest.mark.parametrize("block", [1 << 21, 100_000])
def test_near_copies_in_a_crowd_that_shares_a_passage(spark, monkeypatch, block):
    """All texts are alike at 0.74, too little; planted copies at 0.83 to 0.87 must be found among them, and nothing else. Small blocks are dealt as tiles."""
    monkeypatch.setattr(simhash, "BLOCK_HASHES", block)
    passage, texts = [f"p{i}" for i in range(259)], []
    for k in range(3000):
        texts.append([*passage, *(f"o{k}x{i}" for i in range(45))])
        if k % 20 == 0:
            changed = 21 + k // 20 % 7
            texts.append([*texts[-1][:-changed], *(f"c{k}x{i}" for i in range(changed))])
    texts = [" ".join(t) for t in texts]
    want = alike_groups([five_word_shingles(t) for t in texts])
    assert sum(w != k for k, w in enumerate(want)) == 150
    assert near_group_ids(spark, texts) == want


def test_near_groups_of_long_texts_are_exact_at_the_limit(spark):
    """Pairs of 600 shingles with similarities from 0.76 to 0.84: those at 0.8 and more, and no others."""
    rng, texts = np.random.default_rng(4), []
    for k in range(300):
        base, changed = [f"w{x}" for x in rng.integers(0, 1 << 40, 604)], 52 + k % 31
        texts += [base, [*base[:-changed], *(f"c{k}x{i}" for i in range(changed))]]
    texts = [" ".join(t) for t in texts]
    want = alike_groups([five_word_shingles(t) for t in texts])
    assert 0 < sum(w != k for k, w in enumerate(want)) < 300
    assert near_group_ids(spark, texts) == want


def test_near_groups_of_short_texts_are_exact(spark):
    """Texts of 1 to 25 shingles, and the same with a word or more at the end."""
    rng, texts = np.random.default_rng(6), []
    for k in range(600):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 5 + k % 25)]
        texts += [base, [*base, *(f"c{k}x{i}" for i in range(1 + k // 25 % 6))]]
    texts = [" ".join(t) for t in texts]
    want = alike_groups([five_word_shingles(t) for t in texts])
    assert 0 < sum(w != k for k, w in enumerate(want)) < 600
    assert near_group_ids(spark, texts) == want

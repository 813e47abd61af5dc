"""Sharding, packing, counts, chat and neighbours against plain versions and round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.llm import chat, cross_polytope, encoding, packing, sharding, token_counts


def test_shards_are_exact_and_slots_gapless(spark, sf_dir, docs):
    got = sharding.query(spark, sf_dir).toPandas()
    texts = docs.set_index("doc_id").text
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert all(zlib.crc32(texts[d].encode()) == c and len(texts[d].encode()) + 8 == s for d, c, s in zip(got.doc_id, got.text_crc32, got["size"]))


def plain_shards(rows, n_parts, shards=24, seed=17):
    """(shard, slot) of rows (doc_id, text_crc32, size), in one process: the same draws, done plainly."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def h(*values):
        out = 42
        for v in values:
            out = xxhash.xxh64_intdigest(int(v[0]).to_bytes(4, "little", signed=True) if isinstance(v, tuple) else int(v).to_bytes(8, "little", signed=True), out)
        return signed(out)

    number, keyed = Counter(), []
    for row in sorted(rows):
        number[row] += 1
        own = h((seed,), *row, number[row])
        keyed.append((h((seed + 1,), own) % n_parts, h((seed + 2,), own), own, row))
    sizes = Counter(k[0] for k in keyed)
    matrix = dict(zip(sorted(sizes), sharding.communication_matrix([sizes[p] for p in sorted(sizes)], sharding.even_sizes(len(rows), shards), seed), strict=True))
    sent = []
    for p in matrix:
        queue = [k for k, n in enumerate(matrix[p]) for _ in range(n)]
        for rank, (_, _, own, row) in enumerate(sorted(k for k in keyed if k[0] == p), 1):
            sent.append((queue[rank - 1], h((seed + 3,), own, (p,), (rank,)), row))
    out, slots = [], Counter()
    for s, _, row in sorted(sent):
        out.append((*row, s, slots[s]))
        slots[s] += 1
    return sorted(out), matrix


@pytest.mark.parametrize("part_rows", [20_000, 5])
def test_shards_equal_a_plain_shuffle(spark, sf_dir, docs, part_rows):
    rows = [(d, zlib.crc32(t.encode()), len(t.encode()) + 8) for d, t in zip(docs.doc_id.tolist(), docs.text)]
    rows += [rows[0]] * 60
    df = spark.createDataFrame(rows, "doc_id long, text_crc32 long, size long").repartition(3)
    got = sharding.shard(df, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], part_rows=part_rows).select("doc_id", "text_crc32", "size", "shard", "slot").collect()
    want, matrix = plain_shards(rows, max(24, -(-len(rows) // part_rows)))
    assert sorted(map(tuple, got)) == want and len(matrix) > 20
    assert sum(0 < k < sum(row) for row in matrix.values() for k in row) > 50  # cells that were drawn


def test_equal_rows_go_to_all_parts(spark):
    """Half of all rows are equal: parts are even all the same, and the equal rows' shards too."""
    df = spark.range(5000).selectExpr("CASE WHEN id < 2500 THEN -1 ELSE id END AS doc_id")
    key = sharding.numbered(df, together=300)
    assert key.where("doc_id = -1").select("__number").distinct().count() == 2500 and key.count() == 5000
    parts = [r["count"] for r in key.groupBy(F.pmod(F.xxhash64("doc_id", "__number"), F.lit(24))).count().collect()]
    assert len(parts) == 24 and max(parts) < 1.4 * np.median(parts)
    got = sharding.shard(df, [F.col("doc_id")])
    held = [r["count"] for r in got.where("doc_id = -1").groupBy("shard").count().collect()]
    assert len(held) == 24 and sum(held) == 2500 and max(held) < 2 * min(held)


def test_shuffle_is_uniform(spark):
    """Over seeds, every row visits every shard equally often, and so do pairs of rows of one part."""
    df = spark.range(12)
    where = Counter()
    together = 0
    for seed in range(40):
        rows = {r["id"]: r["shard"] for r in sharding.shard(df, [F.col("id")], shards=3, seed=1000 * seed, part_rows=4).collect()}
        assert sorted(Counter(rows.values()).values()) == [4, 4, 4]
        where.update(rows.items())
        together += sum(rows[2 * i] == rows[2 * i + 1] for i in range(6))
    assert max(where.values()) < 28 and min(where.values()) > 3 and 40 < together < 90  # 65 expected


def test_hypergeometric_draws_have_the_right_mean():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(30, 70, 20, rng) for _ in range(3000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert sharding.hypergeometric(5, 0, 3, rng) == 3 and sharding.hypergeometric(0, 5, 3, rng) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 6))
def test_matrix_margins(parts, shards):
    sizes = sharding.even_sizes(sum(parts), shards)
    m = sharding.communication_matrix(parts, sizes, 5)
    assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m)] == sizes and min(map(min, m)) >= 0


ODD = ["", "It's 'S 're x'll", "a\x85b\xa0c", "İstanbul ΣΑΣ", "²³½ x²y", "naïve Ångström ß ẞ ÿŸ", "\x1c\x1dabc", "<|endoftext|> <|startoftext|>", "hello <|endoftext|> x", "a<|ENDOFTEXT|>b <|endoftext", "日本語 text", "a" * 300, "''s''' don't'", "é café", "\t\r\n", "½½1a2", "µª º", "a\xadb"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.default_path())
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cached_encoding_equals_the_tokenizer(docs, monkeypatch):
    for room in (encoding.CACHE_PIECES, 10):
        monkeypatch.setattr(encoding, "CACHE_PIECES", room)
        texts = ODD + docs.text.tolist()
        assert encoding.WordEncoder(encoding.default_path()).encode(texts) == reference_ids(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=30))
def test_cached_encoding_of_any_text(text):
    encoder = ENCODER
    assert encoder.encode([text]) == reference_ids([text])


ENCODER = encoding.WordEncoder(encoding.default_path())


def test_packing_round_trip(spark, sf_dir, docs):
    got = packing.query(spark, sf_dir).toPandas()
    ids = {d: b + bytes(4) for d, b in zip(docs.doc_id, reference_ids(docs.text.tolist()))}
    assert sorted(zip(got.doc_id, got.piece)) == sorted((d, k) for d, b in ids.items() for k in range(-(-len(b) // 8192)))
    for r in got.itertuples():
        part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.start == 2048 * r.piece and zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
    flat = {r["sequence_id"]: r["ids"] for r in packing.sequences(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    assert all(flat[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)] for r in got.itertuples())
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_slices_change_no_law(spark):
    """Few rows in a slice or many: every piece once, sequences gapless and within capacity, as many of them."""
    rng = random.Random(9)
    table = spark.createDataFrame([(i, 0, 0, 7 if i % 3 else rng.randrange(1, 21), i) for i in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = set()
    for n in (7, 100_000):
        got = packing.pack(table, 20, slice_rows=n).toPandas()
        assert sorted(got.doc_id) == list(range(600))
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 20
        found.add(got.sequence_id.nunique())
        shards = sharding.shard(table, [F.col("doc_id")], shards=3, slice_rows=n).toPandas()
        assert all(sorted(g.slot) == list(range(200)) for _, g in shards.groupby("shard"))
    assert len(found) == 1


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 30))
def test_fullest_is_the_largest_feasible_sum(counts, room):
    best = {0}
    for n, c in counts.items():
        best = {s + n * k for s in best for k in range(c + 1) if s + n * k <= room}
    got = packing.fullest(counts, room)
    assert sum(n * k for n, k in got.items()) == max(best) and all(k <= counts[n] for n, k in got.items())


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_patterns_use_every_piece_once(counts):
    used = Counter()
    for repeats, bin_ in packing.patterns(counts, 40):
        assert sum(n * k for n, k in bin_.items()) <= 40
        used.update({n: repeats * k for n, k in bin_.items()})
    assert used == counts


def test_token_counts_equal_brute_force(spark, sf_dir, docs):
    got = token_counts.query(spark, sf_dir).toPandas().set_index("context_limit")
    n = np.array([len(b) // 4 for b in reference_ids(docs.text.tolist())])
    for limit, r in got.iterrows():
        assert (r.n_docs, r.docs_over, r.tokens_over, r.truncated_total, r.total_tokens) == ((n == limit).sum(), (n > limit).sum(), n[n > limit].sum(), np.minimum(n, limit).sum(), n.sum())
        assert abs(r.share_within - (n <= limit).mean()) < 1e-12
    assert set(token_counts.ASKED) <= set(got.index) and got.n_docs.sum() == len(n)
    hist = token_counts.histogram(token_counts.lengths(spark.createDataFrame(docs[["doc_id", "text"]])))
    for r in token_counts.answers(hist, [0, 1, 77, 500, 10**6]).collect():
        k = r["context_limit"]
        assert (r["docs_over"], r["tokens_over"], r["truncated_total"], r["total_tokens"]) == ((n > k).sum(), n[n > k].sum(), np.minimum(n, k).sum(), n.sum())
    assert token_counts.quantile(hist, 0.5) == np.sort(n)[len(n) // 2 - 1]


def test_chat_reads_back(spark, sf_dir):
    got = chat.query(spark, sf_dir).toPandas().set_index("conv_id")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    probe = [("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)]
    for k, turns in [(-1, probe), *((k, list(zip(g.role, g.text))) for k, g in c.groupby("conv_id"))]:
        flat, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got.n_turns[k], got.turns_sha256[k], got.loss_chars[k], got.loss_sha256[k]) == (len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes_any_text(spark):
    odd = ["\\", "\\\\n", "<|im_end|>", "\\<|", "<\\|im_start|>", "a\nb", "", None, "<|im_start|>assistant\n", "🙂\\|", "<<||"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "ro\nle\\n", "<|im_end|>", None) for t in odd)]
    nodes = chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.read_back(chat.format_paths(nodes)).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r or "", t or "") for *_, r, t in rows]
    assert out["loss_text"] == "".join(t or "" for *_, r, t in rows if r == "assistant") and out["formatted"].count("<|im_end|>") == len(rows)


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, None)]
    got = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_paths(chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got == {None: ["x", "y"], 3: ["a", "a", "b"], 4: [""]}


def test_reply_trees_enumerate_and_rank_branches(spark):
    rng = random.Random(3)
    rows, children = [], {}
    for tree in range(4):
        for i in range(25):
            parent = None if i == 0 else rng.randrange(max(0, i - 4), i)
            children.setdefault((tree, parent), []).append(i)
            rows.append((tree, f"{tree}/{i}", None if parent is None else f"{tree}/{parent}", "user" if i % 2 else "assistant", f"m{i}", float(rng.randrange(5))))
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double")
    by_id = {r[1]: r for r in rows}

    def walk(tree, i, path):
        path = [*path, i]
        below = children.get((tree, i), [])
        return [path] if not below else [p for c in below for p in walk(tree, c, path)]

    got = chat.read_back(chat.format_paths(nodes, best=2)).collect()
    for tree in range(4):
        want = sorted(walk(tree, 0, []), key=lambda p: (-sum(by_id[f"{tree}/{i}"][5] for i in p), f"{tree}/{p[-1]}"))[:2]
        own = sorted((r for r in got if r["tree"] == tree), key=lambda r: r["branch"])
        assert [[t["text"] for t in r["turns"]] for r in own] == [[f"m{i}" for i in p] for p in want]


def test_paths_on_any_graph(spark):
    """Cycles, a leaf and a tail on a cycle, a self-loop, repeated and dangling nodes; a null parent is smallest."""
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("s", "s"), ("t", "s"), ("r", None), ("x", "r"), ("x", "r"), ("y", "gone"), ("z", "y"), ("z", "x"), (None, "r"), ("alone", None)]
    got = sorted((r["leaf"], r["above"], r["node"]) for r in chat.paths(spark.createDataFrame(rows, "node string, parent string")).collect())
    # z is named twice: its parent x comes first
    assert got == [("alone", 0, "alone"), ("y", 0, "y"), ("z", 0, "z"), ("z", 1, "x"), ("z", 2, "r")]


def test_paths_of_a_long_chain(spark):
    chain = spark.range(10_000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = chat.paths(chain).agg(F.count("*").alias("n"), F.min("leaf").alias("a"), F.max("leaf").alias("b"), F.sum(F.col("node") + F.col("above")).alias("s")).first()
    assert (got["n"], got["a"], got["b"], got["s"]) == (10_000, 9_999, 9_999, 9_999 * 10_000)


def exact(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        s = (x * q).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall_and_scores(spark, sf_dir):
    got = cross_polytope.query(spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    want, recall = exact(ids, x, 20), []
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert q % 20 == 0 and list(g["rank"]) == list(range(1, 21))
        scores = dict(zip(ids, (x * x[ids == q]).sum(axis=1)))
        assert np.allclose(g.score, [scores[v] for v in g.vec_id], rtol=0, atol=1e-14) and q not in set(g.vec_id)
        recall.append(len(set(g.vec_id) & {v for v, _ in want[q]}) / 20)
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (20, [2.0, 1.0, 0.0]), (1, [5.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, []), (10, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (40, [0.0, 0.0, 0.0])]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("extra")), lambda c: c % 20 == 0, k=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 5.0), (0, 20, 2.0), (0, 2, 1.0), (0, 3, 1.0), (20, 1, 10.0), (20, None, 3.0), (20, 0, 2.0), (20, 2, 2.0)]  # a vector without an id is a candidate like any other


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_neighbours_with_lengths_and_hot_vectors(spark, monkeypatch, spread):
    monkeypatch.setattr(cross_polytope, "SLICE", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)) * np.exp(spread * rng.normal(size=(900, 1)))
    x[300:600] = x[300]  # a third of all rows
    ids = np.arange(900)
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = cross_polytope.search(df, lambda c: c % 20 == 0, k=10).toPandas()
    want = exact(ids, x, 10)
    recall = [len(set(g.vec_id) & {v for v, _ in want[q]}) / 10 for q, g in got.groupby("query_id")]
    assert len(recall) == 45 and np.mean(recall) >= 0.9


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_in_joined_hashes(spark, monkeypatch, clustered):
    """Cells of several rotations, as many vectors have, and clusters smaller than k: each query still gets k."""
    monkeypatch.setattr(cross_polytope, "CELL", 2)
    monkeypatch.setattr(cross_polytope, "FEWEST", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    if clustered:
        x = 20 * x[rng.integers(0, 400, 3000)] + x
    ids, told = np.arange(3000), {}
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = cross_polytope.search(df, lambda c: c % 20 == 0, k=10, report=told).toPandas()
    want = exact(ids, x, 10)
    recall = [len(set(g.vec_id) & {v for v, _ in want[q]}) / 10 for q, g in got.groupby("query_id")]
    assert len(cross_polytope.levels_for(3000, 16)) > 1 and told["cells"] == 2048 and told["probes"] < 400
    assert len(recall) == 150 and (got.groupby("query_id").size() == 10).all() and np.mean(recall) >= 0.9


def test_probes_come_in_order_of_shortfall():
    index = cross_polytope.Tables(6, 100_000, 2, 3)
    index.levels = [4, 2, 1]
    index.signs = [[cross_polytope.table_signs(t, 8, 3, i) for i in range(3)] for t in range(2)]
    x = np.random.default_rng(2).normal(size=(20, 8))
    whole = index.probes(x, 1, index.cells)
    assert index.cells == 64 and (np.sort(whole, axis=1) == np.arange(64)).all()
    assert (whole[:, 0] == index.codes(x, 1)).all() and (index.probes(x, 1, 7) == whole[:, :7]).all()


def test_rows_that_repeat_an_id_all_take_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (1, [0.0, 1.0])]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 20 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 2.0), (0, 1, 1, 3.0), (0, 2, 0, 0.0), (0, 2, 1, 3.0), (0, 3, 0, 0.0), (0, 3, 1, 0.0)]  # ties to the smaller id


def test_vectors_without_an_id_are_candidates(spark):
    """They come after all others on ties, and none is a query."""
    rows = [(0, [1.0, 0.0]), (None, [0.9, 0.1]), (1, [0.5, 0.5]), (None, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (None, None)]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 2), (0, 2, None), (0, 3, None), (0, 4, 1)]

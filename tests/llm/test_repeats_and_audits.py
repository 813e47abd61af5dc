"""Substring dedup, the divergence audit and the filter audit against plain versions and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from loomvec.llm import debruijn, divergence, filter_audit
from loomvec.llm._words import word_lists

K = 20


def kept_of(rows):
    """For each (doc_id, text): doc_id, words, removed words and the digest of what stays."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), [None] * len(rows)
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - K + 1):
            window = tuple(words[s : s + K])
            if window in seen:
                gone[s : s + K] = [True] * K
            seen.add(window)
        out[i] = (rows[i][0], len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def removed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in debruijn.remove_repeats(df, filter_bits=1 << 16, **how).collect()), key=repr)


def same(rows):
    return sorted(kept_of(rows), key=repr)


def test_repeats_of_the_whole_table(spark, sf_dir, docs):
    got = debruijn.query(spark, sf_dir).toPandas()
    want = kept_of(list(zip(docs.doc_id.tolist(), docs.text.tolist())))
    assert sorted(map(tuple, got[["doc_id", "n_words", "n_removed", "kept_sha256"]].values.tolist())) == sorted(want) and sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("seed, segment", [(1, 4 << 20), (2, 300)])
def test_repeats_of_random_texts(spark, seed, segment):
    """Few words, so that windows repeat within texts and at all distances; passages at edges; texts longer than a segment."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(18, 70))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(passages), rng.choice(passages)[rng.randrange(10) :], " ".join(str(rng.random()) for _ in range(rng.randint(0, 30))), "x y " * rng.randint(0, 30), "\x0b\t\x1c ü ü "]) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 - 50, "\n".join(parts)))
    rows.append((500, "w" * 2000 + " " + " ".join(p for p in passages)))
    assert removed(spark, rows, segment=segment) == same(rows)


def test_repeats_that_are_exactly_a_window_long(spark):
    own = lambda k, n: " ".join(f"o{k}x{j}" for j in range(n))
    window = " ".join(f"w{j}" for j in range(K))
    rows = [(1, f"{own(1, 30)} {window} {own(2, 30)}"), (2, window), (3, f"{own(3, 5)} {window}"), (4, window.rsplit(" ", 1)[0]), (5, f"{window} {window} tail"), (6, None), (7, "")]
    got = removed(spark, rows)
    assert got == same(rows) and [g[2] for g in sorted(got)] == [0, 20, 20, 0, 40, 0, 0]


def test_repeats_among_equal_and_missing_ids(spark):
    """Order among rows of one id is by a hash: which one keeps a passage is free, but just one does; equal rows are copies."""
    passage = " ".join(f"p{j}" for j in range(40))
    rows = [(7, passage), (7, passage), (7, f"a {passage}"), (None, passage), (None, f"b {passage}"), (None, f"b {passage}"), (9, "too short"), (9, "too short")]
    got = removed(spark, rows)
    assert len(got) == 8 and [g[1:3] for g in got if g[0] == 9] == [(2, 0)] * 2
    assert sum(g[1] - g[2] for g in got if g[0] == 7) in (40, 41) and max(g[1] - g[2] for g in got if g[0] is None) <= 1
    assert sum(g[1] - g[2] for g in got if g[0] is None) == 1


def test_a_crowd_of_copies(spark):
    """Copies in every partition, each text with words of its own before and after."""
    shared = " ".join(f"s{j}" for j in range(35))
    rows = [(i, f"{' '.join(f'u{i}q{j}' for j in range(i % 23))} {shared} {' '.join(f'v{i}q{j}' for j in range(i % 7))}") for i in range(400)]
    assert removed(spark, rows) == same(rows)


def test_deceiving_hashes_are_noticed(spark, monkeypatch):
    """A span whose source has other words is never removed."""
    good = debruijn.spans
    calls = []

    def spans(keyed, seed, *more):
        calls.append(seed)
        found = good(keyed, seed, *more)
        return found.withColumn("src_a", found["src_a"] + 1) if len(calls) == 1 else found

    monkeypatch.setattr(debruijn, "spans", spans)
    text = " ".join(f"w{j}" for j in range(50))
    rows = [(1, text + " more"), (2, text)]
    assert removed(spark, rows) == same(rows) and calls == [1, 2]


def test_paths_do_not_depend_on_where_a_text_is_cut():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 64, 5, np.uint64)[rng.integers(0, 5, 3000)]
    whole = debruijn.paths(h, np.zeros(3000, int), 1)
    start = int(whole.start[100])
    tail = debruijn.paths(h[start:], np.zeros(3000 - start, int), 1)
    assert (tail.content == whole.content[100:]).all() and (tail.n == whole.n[100:]).all() and whole.n.sum() == 3000 - K + 1 and whole.n.max() <= 13


def test_word_lists_are_cut_between_words(monkeypatch):
    monkeypatch.setattr("loomvec.llm._words.PIECE_BYTES", 7)
    text = b"  one two\x0bthree " + b"x" * 40 + b"\n\n four\x1cfive "
    assert [w for some in word_lists(text) for w in some] == text.split()


# Divergence


def terms(text):
    return re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def divergence_of(rows, least, top):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups.add((lang, source))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, c in df[lang].items() if c >= least]
        of_lang = sum((n[g] for g in groups if g[0] == lang), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(n[lang, source]), share(of_lang)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                r = share(n[other])
                pairs.append((-sum(f(p[t], r[t]) for t in kept), other[1].encode()))
        own = [(-f(p[t], q[t]), t.encode()) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
            out += [(lang, source, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk, block, stripe", [(4096, 32, 8), (3, 2, 1)])
def test_divergence_of_small_groups(spark, monkeypatch, chunk, block, stripe):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("STRIPE", stripe)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    words = ["Ähre", "ähre", "the", "The", "don't", "naïve", "x1y", "日本", "🙂", "of", "Q", "zoo", "a\x00b"]
    rows = [(rng.choice(["en", None, "de"]), rng.choice(["s1", "s2", None, "S1", "é", "t1", "t2"]), " ".join(rng.choices(words, range(1, 14), k=rng.randint(0, 12)))) for _ in range(120)]
    rows += [("fr", "only", "rare words"), ("it", "a", None), ("it", "b", "1 2 3"), ("", "s9", "the the")] + [("en", "s1", None)] * 2
    df = spark.createDataFrame([(1, *r, "extra") for r in rows], "doc_id long, lang string, source string, text string, term string")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, 3, 4).collect())
    assert got == divergence_of(rows, 3, 4) and len(got) > 60


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 1, 10**12, 9 * 10**15 - 5], np.int64)
    total, kept = 9 * 10**15 - 10, 4
    assert divergence.shares(n, total, kept).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 2 * kept) for x in n]


@pytest.mark.parametrize("operator", [divergence, filter_audit])
def test_sql_on_odd_and_small_tables(spark, operator, odd_dir, sf_dir):
    for folder, files in ((odd_dir, "/*.parquet"), (sf_dir, "")):
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{files}')")
        want = con.execute(operator.ORACLE_SQL).fetchdf()
        got = operator.query(spark, folder).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist())) and len(got)


# Filters


def failed(text):
    words = (text or "").encode().split()
    text = text or ""
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text))
    return {f for f, bad in zip("ABCD", tests) if bad}


def interactions_of(rows, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    low = {}
    for d, _, text in rows:
        if d is not None:
            low[text or ""] = min(d, low.get(text or "", d))
    docs = [(d, s or "", failed(t) | ({"E"} if d is not None and low[t or ""] < d else set())) for d, s, t in rows]
    out = {}
    for part in {s for _, s, _ in docs}:
        own = [(d, f) for d, s, f in docs if s == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def filter_rows():
    rng = random.Random(8)
    texts = ["", None, "Short One", "a " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i}" for i in range(200)) + " 100%", "Ü" * 50 + "AB"]
    rows = [(rng.randrange(-40, 90) if rng.random() < 0.9 else None, rng.choice(["s", None, "", "t"]), rng.choice(texts) if rng.random() < 0.8 else f"own {i}") for i in range(150)]
    return rows + [(5, "s", texts[4])] * 40, [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(-40, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_filter_interactions(spark, ranges):
    """With more ranges than texts, groups of copies lie across boundaries."""
    rows, labels = filter_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, mask int")
        got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got == interactions_of(rows, labels) and len(got) == 3 * 600

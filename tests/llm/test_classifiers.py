"""Language, toxicity and mixing: held-out accuracy, the counterfactual term, and targets met."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomvec.llm import language_id, mixing, toxicity


def test_languages_held_out(spark, sf_dir, docs):
    got = language_id.query(spark, sf_dir).toPandas().merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out & (got.text.str.len() > 40)]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()


def test_language_of_texts_without_letters(spark, odd_dir):
    got = language_id.query(spark, odd_dir).toPandas().set_index("doc_id")
    assert {got.lang_pred[i] for i in (2, 3, 4, 8)} == {"und"} and got.lang_pred[9] != "und"


def test_whole_text_decides():
    model = language_id.train(["aaaa bbbb " * 40, "cccc dddd " * 40] * 10, ["x", "y"] * 10)
    t = model.tables()
    langs, _ = language_id.predict(model, t, ["aaaa bbbb " * 30, "aaaa bbbb " * 30 + "cccc dddd " * 90])
    assert langs == ["x", "y"]
    assert language_id.predict(None, {}, ["abc"]) == (["und"], [0.0])


def test_folded_tables_equal_plain_convolution():
    model = language_id.train(["some text here", "und noch ein text"], ["en", "de"], steps=1)
    x = language_id.windows_of(b"check this window")
    plain = []
    for w in (2, 3, 4):
        a = np.stack([sum(model.filters[w][j][x[0, p + j]] for j in range(w)) + model.bias[w] for p in range(language_id.WINDOW - 3)])
        plain.append(np.maximum(a.max(axis=0), 0))
    z = np.concatenate(plain) @ model.out + model.out_bias
    assert np.allclose(model.log_probabilities(x, model.tables())[0], z - np.log(np.exp(z).sum()), atol=1e-4)


def test_toxicity_held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    got = toxicity.query(spark, sf_dir).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.85


def biased(n=300):
    """Toxic texts that happen to name one group more often."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, 12))
        y = int(i % 3 == 0)
        if y:
            own.append("idiot" if rng.random() < 0.8 else "scum")
        if rng.random() < (0.8 if y else 0.2):
            own.append("muslim")
        elif rng.random() < 0.3:
            own.append("christian")
        texts.append(" ".join(own))
        labels.append(y)
    return texts, labels


def test_swapping_a_group_changes_no_score():
    texts, labels = biased()
    gap = {}
    for strength in (0.0, 20.0):
        model = toxicity.train(texts, labels, counterfactual=strength)
        gap[strength] = abs(model.word_score("muslim") - model.word_score("christian"))
        scores = toxicity.score_texts(model, ["you idiot w1 w2", "a muslim w1 w2", None, ""], {})
        assert scores[0] > 0.5 and scores[2] == scores[3]
    assert gap[20.0] < 0.3 * gap[0.0]


def test_no_labels_no_scores():
    assert toxicity.train(["a", "b"], [0, 0]) is None and (toxicity.score_texts(None, ["x"], {}) == 0).all()


def least_squares(p, w, targets, steps=200_000):
    """Plain projected gradient over one rate for each document."""
    r, a = np.ones(len(p)), p * w[:, None]
    size = 1 / np.linalg.norm(a.T @ p, 2)
    for _ in range(steps):
        gap = a.T @ r - targets
        new = np.maximum(0, r - size * (p @ gap))
        if np.abs(new - r).max() < 1e-13:
            break
        r = new
    return float(np.linalg.norm(a.T @ r - targets))


def test_rates_reach_the_least_squares(spark, sf_dir):
    got = mixing.query(spark, sf_dir).toPandas()
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert len(got) == 200 and np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all()
    w, targets = got.n_tokens.to_numpy() / got.n_tokens.sum(), np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    left = np.linalg.norm((w * got.rate) @ p - targets)
    assert abs(left - got.residual[0]) < 1e-9 and left <= least_squares(p, w, targets) + 1e-4
    assert ((got.copies - got.rate).abs() < 1).all()


def domain_table(spark, p, n):
    return spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p)], "n_tokens long, p_high double, p_low double, p_toxic double")


@pytest.mark.parametrize("targets", [[0.5, 0.3, 0.2], [0.05, 0.05, 0.9], [0.98, 0.01, 0.01], [1.0, 0.0, 0.0], [2.0, 1.0, 0.5]])
def test_projected_gradient_equals_least_squares(spark, targets):
    """Targets within reach are met; beyond reach the distance is the least there is."""
    rng = np.random.default_rng(0)
    p = np.clip(rng.dirichlet([2, 1, 1], 400), 0.02, None)
    p, n = p / p.sum(axis=1, keepdims=True), rng.integers(1, 50, 400)
    table = domain_table(spark, p, n)
    move, residual = mixing.fit_rates(table, targets)
    r = table.withColumn("rate", mixing.rate(move)).toPandas().rate.to_numpy()
    w = n / n.sum()
    assert (r >= 0).all() and abs(np.linalg.norm((w * r) @ p - targets) - residual) < 1e-9
    assert residual <= least_squares(p, w, np.array(targets)) + 1e-4


def test_rates_given_probabilities_equal_sql(spark):
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([2, 1, 1], 300), rng.integers(1, 50, 300)
    table = domain_table(spark, p, n)
    move, residual = mixing.fit_rates(table, [0.5, 0.3, 0.2])
    frame = table.toPandas()  # noqa: F841 (read by the SQL)
    sums = duckdb.sql("SELECT " + ", ".join(f"sum(n_tokens * r * p_{d}) / sum(n_tokens)" for d in mixing.DOMAINS) + f" FROM (SELECT *, greatest(0, 1 - ({' + '.join(f'p_{d} * {x!r}' for d, x in zip(mixing.DOMAINS, move))})) AS r FROM frame)").fetchall()[0]
    assert np.allclose(sums, [0.5, 0.3, 0.2], atol=1e-5) and residual < 1e-5


def test_membership_equals_plain_sums(spark, odd_docs, odd_labels):
    model = mixing.Membership([-0.5, -1.5, -2.5], [3, 77, 500, 9000], [[1.0, 0.0, -1.0], [0.5, 0.25, 0.0], [0.0, 2.0, 0.0], [-1.0, 0.0, 3.0]])
    seen = {r["doc_id"]: r["__features"] for r in mixing.with_features(odd_docs.where("doc_id in (1, 2, 3, 5, 9)")).collect()}
    model.buckets = sorted({f for x in seen.values() for f in x[:2]})
    model.weights = [[0.125 * k, 0.5 - 0.0625 * k, -0.25] for k in range(len(model.buckets))]
    got = {r["doc_id"]: r for r in mixing.members(odd_docs, model).where("doc_id in (1, 2, 3, 5, 9)").collect()}
    for d, features in seen.items():
        z = np.array(model.priors) + sum((np.array(w) for b, w in zip(model.buckets, model.weights) if b in features), np.zeros(3))
        assert np.allclose([got[d][f"p_{k}"] for k in mixing.DOMAINS], np.exp(z) / np.exp(z).sum())
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[5]["n_tokens"] == 40_000


def test_mix_repeats_rows_as_planned(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"high": 1.5, "low": 0.2, "toxic": 0.3}
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan(docs, labels, targets).collect()}
    got = Counter(r["doc_id"] for r in mixing.mix(docs, labels, targets).select("doc_id").collect())
    assert got == Counter({d: n for d, n in planned.items() if n}) and max(got.values()) > 1


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(2)
    words = {"aa": ["tama", "keru", "sopi", "lanu"], "bb": ["zwrk", "gdyx", "prsk", "vlbt"]}
    rows = [(k, " ".join(rng.choice(words["aa"], 30)), "aa") for k in range(1500)] + [(5000 + k, " ".join(rng.choice(words["bb"], 30)), "bb") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample=100)
    assert model.languages == ["aa", "bb"]
    assert language_id.predict(model, model.tables(), ["gdyx vlbt zwrk prsk gdyx", "tama sopi lanu keru"])[0] == ["bb", "aa"]


def test_every_start_is_in_one_window():
    text = bytes(range(1, 251)) * 5
    w = language_id.windows_of(text)
    assert b"".join(x[: language_id.STARTS].tobytes() for x in w).rstrip(b"\0") == text
    assert all((a[language_id.STARTS :] == b[: language_id.WIDEST - 1]).all() for a, b in zip(w, w[1:]))


def test_scores_equal_plain_sums(spark, sf_dir, docs):
    """The query's scores against the model's weights, summed plainly over the distinct words of whole texts."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = toxicity.query(spark, sf_dir).toPandas().set_index("doc_id").score
    for d, t in zip(docs.doc_id, docs.text):
        z = model.bias + sum(float(model.weights[f]) for w in toxicity.words_of(t) for f in toxicity.features(w))
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_every_language_is_learned_from_bounded_texts(spark, monkeypatch):
    """More languages than the sample has texts, and very long ones: all are learned, from pieces of the whole text."""
    rows = [(k * 10 + j, (f"lang{k} " * 9000 if k < 3 else f"words of {k} {j}"), f"l{k:02d}") for k in range(40) for j in range(6)]
    seen = {}

    def caught(sample, order, train):
        seen["rows"] = sample.toPandas()
        return b""

    monkeypatch.setattr(language_id, "in_one_task", caught)
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5)
    got = seen["rows"]
    assert set(got.lang) == {f"l{k:02d}" for k in range(40)} and got.text.str.len().max() == language_id.LEARNED_CHARS
    assert got[got.lang == "l01"].text.iloc[0].count("lang1") > 2000

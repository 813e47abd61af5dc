"""Toxicity scores from a counterfactually regularised linear classifier.

A document's logit is a bias plus the sum of the scores of its distinct words; a word's score is the sum of
the weights of its hashed features (the word itself and its leading characters, so that inflected forms share
evidence). Beside the logistic loss, training swaps identity terms: every labelled text that names a group is
paired with the same text naming another group of its kind, and labelled texts are paired with themselves
plus a neutral mention of a group. The squared change of the logit within such a pair is part of the
loss, so naming a group can't by itself raise a score.

Training uses a bounded sample of labelled documents outside the held-out fold: words are hashed where the texts are, and the
fit, in numpy, is one task's work, so the driver sees only the finished weights.
Scoring runs on the executors over whole texts. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get the score of the bias alone; with no labelled text, or only one
class, every score is 0; an empty table gives no rows. Very long texts count with all their words. Repeated rows, null ids and extra
columns pass through untouched, and equal texts get equal scores; a score of exactly 0.5 is predicted 1. A label that
occurs more than once for a document counts as its largest value, and of documents that share an id the first text in order is learned.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomvec.llm._common import blocks, crc_remainder, hash_fraction, in_one_task, small_batches, spread, trimmed

BITS = 20
CACHE_WORDS = 150_000
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")

#: Groups of interchangeable identity terms, for counterfactual swaps.
IDENTITY_TERMS: dict[str, list[str]] = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "gender": ["woman", "man", "girl", "boy", "female", "male", "transgender", "nonbinary"],
    "people": ["women", "men", "girls", "boys", "females", "males"],
    "orientation": ["gay", "lesbian", "bisexual", "heterosexual", "queer", "straight"],
    "origin": ["african", "asian", "european", "american", "latino", "arab", "indian", "chinese", "mexican", "black", "white"],
    "age": ["young", "old", "elderly", "teenage"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "ausländer"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"],
}
KIND = {t: k for k, terms in IDENTITY_TERMS.items() for t in terms}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its first 4, 5 and 6 characters."""
    parts = [f"w {word}", *(f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def word_score(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


def swapped(words: set[str], rng: np.random.Generator) -> set[str] | None:
    """The words with every identity term replaced by another of its kind; ``None`` if there is none."""
    own = sorted(w for w in words if w in KIND)
    if not own:
        return None
    return (words - set(own)) | {str(rng.choice([t for t in IDENTITY_TERMS[KIND[w]] if t != w])) for w in own}


TERMS = sorted(KIND)
#: Places of a word's features (see ``features``); a word too short for a stem has none there.
PARTS, NONE = 4, (1 << BITS)


def hashed(words: list[str], cache: dict[str, list[int]]) -> np.ndarray:
    """(words, PARTS) features; ``cache`` keeps those of up to CACHE_WORDS words."""
    out = []
    for w in words:
        own = cache.get(w)
        if own is None:
            own = features(w)
            own += [NONE] * (PARTS - len(own))
            if len(cache) < CACHE_WORDS:
                cache[w] = own
        out += own
    return np.array(out, np.int32).reshape(-1, PARTS)


def example(text: str | None, cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the text's words, and of the words that its counterfactual loses and gains: a swap of the groups that it names, or a neutral mention of one."""
    own = words_of(text)
    rng = np.random.default_rng(zlib.crc32((text or "").encode()))  # the text alone decides, whatever the order of rows
    other = swapped(own, rng)
    lost, gained = (sorted(own - other), sorted(other - own)) if other is not None else ([], [TERMS[rng.integers(len(TERMS))]])
    return hashed(sorted(own), cache), hashed(lost, cache), hashed(gained, cache)


def fit_weights(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int], counterfactual: float = 1.0, l1: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Minimise logistic loss + ``counterfactual`` x mean squared logit change over the counterfactuals + ``l1`` |weights|.

    (features, weights, bias); ``None`` if there are no two classes.
    """
    if len(set(labels)) < 2:
        return None
    n, y = len(labels), np.array(labels, float)
    mean = y.mean()
    # a word is told by its features; the first place always has one
    parts = np.concatenate([x for e in examples for x in e])
    key = parts[:, 0].astype(np.uint64)
    for k in range(1, PARTS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k].astype(np.uint64)
    _, first, word = np.unique(key, return_index=True, return_inverse=True)
    words = parts[first]
    sizes = np.array([[len(x) for x in e] for e in examples])
    kind, owner = np.tile(np.arange(3), n).repeat(sizes.reshape(-1)), np.arange(n).repeat(sizes.sum(axis=1))
    col, row = word[kind == 0].astype(np.int32), owner[kind == 0].astype(np.int32)
    pcol, prow, psign = word[kind > 0], owner[kind > 0], np.where(kind[kind > 0] == 2, 1.0, -1.0)
    fword, place = np.nonzero(words < NONE)
    used, fcol = np.unique(words[fword, place], return_inverse=True)
    # how far each feature's odds are from even, in standard errors; rare and even features get no say
    seen = np.bincount(fcol, np.bincount(col, minlength=len(words))[fword].astype(float), len(used))
    toxic = np.bincount(fcol, np.bincount(col, y[row], len(words))[fword], len(used))
    spread_ = (toxic - seen * mean) / np.sqrt(np.maximum(seen, 1) * mean * (1 - mean))
    scale = np.where((seen >= 3) & (np.abs(spread_) > 3), np.sqrt(np.minimum(np.abs(spread_), 10) / 10), 0.0)
    # identity terms are always features, so that the counterfactuals can hold them down
    terms = np.flatnonzero(np.isin(used, hashed(TERMS, {})))
    scale[terms] = np.maximum(scale[terms], 0.1)
    some = np.flatnonzero(scale)
    at = np.full(len(used), -1)
    at[some] = np.arange(len(some))
    held = scale[fcol] > 0
    fword, fcol, scale, used = fword[held], at[fcol[held]], scale[some], used[some]
    # words without a feature that counts are left out
    live = np.zeros(len(words), bool)
    live[fword] = True
    name = np.cumsum(live) - 1
    row, col = row[live[col]], name[col[live[col]]]
    prow, pcol, psign = (x[live[pcol]] for x in (prow, name[pcol], psign))
    fword, n_words = name[fword], int(live.sum())
    balance = np.where(y > 0, 0.25 / max(mean, 1e-9), 0.25 / max(1 - mean, 1e-9)) / n + 0.5 / n
    w, g2, b, gb2 = np.zeros(len(used)), np.full(len(used), 1e-12), float(np.log((mean + 1e-9) / (1 - mean + 1e-9))), 1e-12
    for _ in range(steps):
        s = np.bincount(fword, (w * scale)[fcol], n_words)
        z = np.bincount(row, s[col], n) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        d = np.bincount(prow, s[pcol] * psign, n)
        gs = np.bincount(col, r[row], n_words) + np.bincount(pcol, 2 * counterfactual / n * d[prow] * psign, n_words)
        g = np.bincount(fcol, gs[fword], len(used)) * scale
        g2 += g * g
        rate = 0.3 / np.sqrt(g2)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        gb = r.sum()
        gb2 += gb * gb
        b -= 0.1 * gb / np.sqrt(gb2)
    kept = np.flatnonzero(w)
    return used[kept].astype(np.int32), (w * scale)[kept].astype(np.float32), b


def model_of(found: tuple[np.ndarray, np.ndarray, float] | None) -> ToxicityModel | None:
    if found is None:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[found[0]] = found[1]
    return ToxicityModel(weights, found[2])


def train(texts: list[str | None], labels: list[int], **options) -> ToxicityModel | None:
    cache: dict[str, list[int]] = {}
    return model_of(fit_weights([example(t, cache) for t in texts], labels, **options))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000) -> ToxicityModel | None:
    """Learn from about ``sample`` labelled documents (all, if there are fewer) outside the held-out fold (crc32 of the id modulo 5 is 0): a fixed pseudo-random share of ids."""
    usable = labels.where((crc_remainder("doc_id", 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if not n:
        return None
    drawn = hash_fraction("doc_id", sample / n, "toxicity")
    # the label side is bounded by the sample, so it may be broadcast; copies of a row combine before they are shuffled
    rows = docs.select("doc_id", "text").where(drawn).join(F.broadcast(usable.where(drawn)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = small_batches(rows).select(F.xxhash64("text", "doc_id").alias("place"), "text", (F.col("toxic") > 0).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            for b in blocks(batch, "text"):
                found = [example(t, cache) for t in b.column("text").to_pylist()]
                cols = {c: pa.array([e[k].tobytes() for e in found], pa.binary()) for k, c in enumerate(("own", "lost", "gained"))}
                yield pa.RecordBatch.from_pydict({"place": b.column("place"), "y": b.column("y"), **cols})

    def learn(table: pa.Table) -> bytes:
        take = lambda c: [np.frombuffer(x, np.int32).reshape(-1, PARTS) for x in table.column(c).to_pylist()]
        return pickle.dumps(fit_weights(list(zip(take("own"), take("lost"), take("gained"), strict=True)), table.column("y").to_pylist()))

    examples = rows.mapInArrow(trimmed(run), "place long, y int, own binary, lost binary, gained binary")
    found = in_one_task(examples, ["place", "y"], learn)
    return model_of(pickle.loads(found)) if found else None


def score_texts(model: ToxicityModel | None, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
    """Score of every whole text; ``cache`` keeps the scores of words, up to CACHE_WORDS of them."""
    if model is None:
        return np.zeros(len(texts))
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        total = model.bias
        words = words_of(text)
        known = [cache.get(w) for w in words]
        if None in known:
            for w, k in zip(words, known, strict=True):
                if k is None:
                    k = model.word_score(w)
                    if len(cache) < CACHE_WORDS:
                        cache[w] = k
                total += k
        else:
            total += sum(known)
        out[i] = total
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model: ToxicityModel | None, keep: list[str] | None = None, name: str = "tox_score") -> DataFrame:
    """``keep`` columns (default: all) of every document, with its score; a column of that ``name`` is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    inner = small_batches(spread(docs)).select("text", F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`") for c in keep if c != "text"]).alias("row"))
    text_out = "text" in keep
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias) if model else None)  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(*shared.value) if shared.value else None
        cache: dict[str, float] = {}
        for batch in batches:
            for b in blocks(batch, "text"):
                cols = {"row": b.column("row"), name: pa.array(score_texts(m, b.column("text").to_pylist(), cache), pa.float64())}
                yield pa.RecordBatch.from_pydict(({"text": b.column("text")} if text_out else {}) | cols)

    fields = inner.schema.fields if text_out else [inner.schema["row"]]
    out = inner.mapInArrow(trimmed(run), T.StructType([*fields, T.StructField(name, T.DoubleType())]))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep], name)


def query(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    thin = docs.select("doc_id", "text", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return score(thin, model, ["doc_id", "held_out"]).select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str, limit: float = 0.5) -> DataFrame:
    """Documents that score below ``limit``; toxic ones go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, name="__toxicity").where(F.col("__toxicity") < limit).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Language identification with a byte-level convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter is max-pooled over its
window, and a softmax layer maps the pooled values to the languages seen in training. Windows overlap by as many bytes as the widest filter
needs, so every byte of a text is once, and only once, where a filter begins. Training is plain
numpy, in one task, over every window of a bounded sample of labelled texts; of each language the sample has about as many texts, or all
there are. Prediction runs on the executors, over every
window of every text; a document's prediction is the length-weighted mean of its windows' log-probabilities.

Defined results: a null text, or one with no letter, is ``und`` with score 0; with no labelled text at all
every document is ``und``; an empty table gives no rows. Very long texts count with all their windows, in bounded lists. Ties between
languages go to the first in alphabetical order. Repeated rows,
null ids and extra columns pass through untouched, and equal texts get equal results.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomvec.llm._common import blocks, crc_remainder, hash_fraction, in_one_task, small_batches, spread, trimmed

UNDETERMINED = "und"
#: Bytes of a window, the widest filter, and the starts that a window is answerable for.
WINDOW, WIDEST = 256, 4
STARTS = WINDOW - WIDEST + 1
#: Training steps at least, and windows of a step.
STEPS, BATCH = 800, 64
#: Characters of a text that is learned from: of a longer one, as many in pieces of a window's length spread evenly over it.
LEARNED_CHARS = 16_384
#: Texts that each language has to learn from at least, on average, if it has them.
LEAST_TEXTS = 8
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteConvNet:
    """Parameters of the network: ``filters[w][j]`` maps the byte at offset ``j`` of a width-``w`` filter to its weights."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict:
        """Filters folded into byte-pair tables, so that a position costs a few lookups instead of one for each byte."""
        first, second = np.divmod(np.arange(65536), 256)
        pair = {w: f[0][first] + f[1][second] + self.bias[w] for w, f in self.filters.items()}
        head = np.concatenate([pair[w] for w in sorted(pair)], axis=1).astype(np.float32)
        return {"head": head, "third": self.filters[3][2].astype(np.float32), "last": (self.filters[4][2][first] + self.filters[4][3][second]).astype(np.float32)}

    def log_probabilities(self, windows: np.ndarray, t: dict) -> np.ndarray:
        """(n, WINDOW) bytes to (n, languages) log-probabilities; every filter begins at each of the first STARTS bytes."""
        n, f = self.filters[2].shape[2], len(windows)
        x = windows.astype(np.int32)
        two = x[:, :-1] * 256 + x[:, 1:]
        head = t["head"][two[:, :-2]]
        head[:, :, n : 2 * n] += t["third"][x[:, 2:-1]]
        head[:, :, 2 * n :] += t["last"][two[:, 2:]]
        pooled = np.maximum(head.max(axis=1), 0.0)
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return (z - np.log(np.exp(z).sum(axis=1, keepdims=True))).reshape(f, -1)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as windows of WINDOW bytes, each beginning STARTS bytes after the one before; zeros follow the text."""
    n = max(1, -(-len(text) // STARTS))
    out = np.zeros(n * STARTS + WIDEST - 1, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STARTS]


def train(texts: list[str], labels: list[str], n_filters: int = 12, steps: int = STEPS, seed: int = 7) -> ByteConvNet | None:
    """Fit the network by Adam on all windows of the texts, each once at least; ``None`` if there is nothing to learn from."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return None
    windows = [windows_of(t.encode()) for t in texts]
    x, y = np.concatenate(windows), np.repeat([languages.index(lang) for lang in labels], [len(w) for w in windows])
    del windows
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = 1 / np.maximum(share, 1e-9)[y] / len(languages)  # rare languages count as much as common ones
    # filters side by side, the widest first: offset j has those wider than j
    n, f = n_filters, np.float32
    p = {f"f{j}": rng.normal(0, 0.3, (256, (WIDEST - max(j, 1)) * n)).astype(f) for j in range(WIDEST)}
    p |= {"b": np.zeros(3 * n, f), "o": rng.normal(0, 0.2, (3 * n, len(languages))).astype(f), "c": np.zeros(len(languages), f)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    while step < steps:
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            i = order[at : at + BATCH]
            b, rows = x[i].astype(np.int64), np.arange(len(i))[:, None]
            a = p["f0"][b[:, :STARTS]]
            for j in range(1, WIDEST):
                a[:, :, : p[f"f{j}"].shape[1]] += p[f"f{j}"][b[:, j : STARTS + j]]
            where = a.argmax(axis=1)
            h0 = np.take_along_axis(a, where[:, None, :], axis=1)[:, 0] + p["b"]
            h = np.maximum(h0, 0)
            z = h @ p["o"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(i)), y[i]] -= 1
            q *= (weight[i] / len(i))[:, None].astype(f)
            g = {"o": h.T @ q + f(1e-4) * p["o"], "c": q.sum(axis=0)}
            d = (q @ p["o"].T) * (h0 > 0)
            g["b"] = d.sum(axis=0)
            for j in range(WIDEST):
                own = p[f"f{j}"].shape[1]
                cells = b[rows, where[:, :own] + j] * own + np.arange(own)
                g[f"f{j}"] = np.bincount(cells.reshape(-1), d[:, :own].reshape(-1), 256 * own).reshape(256, own).astype(f)
            step += 1
            for k, d in g.items():
                m[k] += f(0.1) * (d - m[k])
                v[k] += f(0.001) * (d * d - v[k])
                p[k] -= f(0.01 / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / f(1 - 0.999**step)) + f(1e-8))
    part = {w: slice((WIDEST - w) * n, (WIDEST - w + 1) * n) for w in (2, 3, 4)}
    return ByteConvNet(languages, {w: np.stack([p[f"f{j}"][:, part[w]] for j in range(w)]) for w in part}, {w: p["b"][part[w]] for w in part}, np.concatenate([p["o"][part[w]] for w in (2, 3, 4)]), p["c"])


def predict(model: ByteConvNet | None, tables: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of every whole text."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    raw = [texts[i].encode() for i in rows]
    lengths = np.array([len(t) for t in raw], np.int64)
    counts = np.maximum(1, -(-lengths // STARTS))
    ends = np.cumsum(counts)
    total, owner = np.zeros((len(rows), len(model.languages))), np.repeat(np.arange(len(rows)), counts)
    starts = np.minimum(STARTS, np.repeat(lengths, counts) - (np.arange(len(owner)) - np.repeat(ends - counts, counts)) * STARTS)
    held = [w for t in raw for w in [windows_of(t)]]
    for at in range(0, len(owner), 256):
        some = np.arange(at, min(at + 256, len(owner)))
        own = owner[some]
        w = np.concatenate([held[k][some[own == k] - (ends[k] - counts[k])] for k in np.unique(own).tolist()])
        np.add.at(total, own, model.log_probabilities(w, tables) * starts[some, None])
    mean = total / np.maximum(lengths, 1)[:, None]
    q = np.exp(mean - mean.max(axis=1, keepdims=True)) if rows else mean
    best = mean.argmax(axis=1) if rows else []
    for k, i in enumerate(rows):
        langs[i], scores[i] = model.languages[best[k]], float(q[k, best[k]] / q[k].sum())
    return langs, scores


def fit(docs: DataFrame, sample: int = 4000) -> ByteConvNet | None:
    """Learn from about ``sample`` labelled texts outside the held-out fold (crc32 of the id modulo 4 is 2), as even between languages as there are texts.

    Each language's share is drawn by a hash of the text, so copies of one text are one example. Every language is learned: the rows are bounded by
    ``sample`` or LEAST_TEXTS for each language, whichever is more, and each text by LEARNED_CHARS.
    """
    usable = docs.where((crc_remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    # a row for each language, of which the network has an output
    found = usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    if not found:
        return None
    each = max(sample / len(found), LEAST_TEXTS)
    shares = json.dumps({r["lang"]: int(min(1.0, each / max(r["n"], 1)) * (1 << 30)) for r in found})
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("language"), "text"), F.lit(1 << 30)) < F.element_at(F.from_json(F.lit(shares), "map<string,bigint>"), F.col("lang")))
    pieces = LEARNED_CHARS // WINDOW
    spread_out = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring("text", (i * (F.length("text") - WINDOW) / (pieces - 1)).cast("int") + 1, F.lit(WINDOW))))
    rows = drawn.select(F.when(F.length("text") <= LEARNED_CHARS, F.col("text")).otherwise(spread_out).alias("text"), "lang").distinct()

    def learn(table: pa.Table) -> bytes:
        return pickle.dumps(vars(train(table.column("text").to_pylist(), table.column("lang").to_pylist())))

    learned = in_one_task(small_batches(rows), ["text", "lang"], learn)
    return ByteConvNet(**pickle.loads(learned)) if learned else None


def identify(docs: DataFrame, model: ByteConvNet | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (default: all) of every document, with its language and score; the text alone decides.

    Columns that have the ``names`` of the results already are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    inner = small_batches(spread(docs)).select("text", F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`") for c in keep if c != "text"]).alias("row"))
    text_out = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else {}
        for batch in batches:
            for b in blocks(batch, "text"):
                langs, scores = predict(model, tables, b.column("text").to_pylist())
                cols = {"row": b.column("row"), names[0]: pa.array(langs, pa.string()), names[1]: pa.array(scores, pa.float64())}
                yield pa.RecordBatch.from_pydict(({"text": b.column("text")} if text_out else {}) | cols)

    fields = inner.schema.fields if text_out else [inner.schema["row"]]
    out = inner.mapInArrow(trimmed(run), T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep], *names)


def query(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = docs.select("doc_id", "text", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return identify(thin, fit(docs), ["doc_id", "held_out"])


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is recognised with a score of at least ``least``; the rest go."""
    marked = identify(docs, fit(docs), names=("__language", "__sureness"))
    return marked.where((F.col("__language") != UNDETERMINED) & (F.col("__sureness") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])

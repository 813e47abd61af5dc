"""Mixing sources to target weights with soft domain membership.

A classifier fitted on the labelled table predicts for every document the probabilities of its domains; document rates
(expected copies, at least zero) are then fitted by projected least squares so that the expected tokens of
each domain, the sum of rate x tokens x probability, match the targets. A gradient step for each document would need its rate to be kept; the steps here
are taken on one multiplier for each domain, and scaled by second moments, which makes them Newton's.

A document's rate is one copy, moved against the sum of all gradient steps so far and projected to at least zero:
max(0, 1 - p . move). So all that a step needs is one aggregate over documents, the domains' expected tokens and
their second moments among documents above zero, which scale the gradient; ``move`` has one number for each domain,
and rates are never stored. Steps go on until the gap is closed, or, where no rates close it, until it can't get smaller.

Classifier: distinct words and a few shape marks of a text, hashed into FEATURES buckets; per domain a weight for each
bucket that is significantly over- or under-represented in a bounded sample of labelled documents. Everything is
DataFrame functions, and nothing that grows with the documents is shuffled: weights are a literal of FEATURES buckets.

Defined results: null and empty texts have no tokens, the domains' prior probabilities and a rate like any other; with no
labelled documents the probabilities are equal; an empty table gives no rows. A domain with a target but no probability
anywhere stays unmatched; ``residual`` has the distance left between wanted and expected shares. Very long texts count with all
their words. Ties can't matter: nothing is chosen by order but the text of a repeated labelled id. Repeated rows count once each, and equal rows get equal copies; of labelled rows that share an id the
largest labels hold, and of documents that share one the first text in order is learned from. Extra columns are kept by ``mix``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm._common import checkpointed, hash_fraction, spread

DOMAINS = ("high", "low", "toxic")
#: Target tokens, as shares of all tokens.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
#: Of the pipeline's stage, which comes after the toxicity filter.
STAGE_TARGETS = {"high": 0.98, "low": 0.02, "toxic": 0.0}
FEATURES = 1 << 15
#: How many standard errors from even make a bucket significant, and how much the evidence of single buckets counts.
SIGNIFICANT, SOFTNESS = 4.0, 2.0
#: Pull of the rates towards one copy, against the squared distance from the targets. The first only decides between rates that match
#: them equally well; the stage's also keeps rates moderate where targets are out of reach, at the price of a larger distance.
PULL, STAGE_PULL = 1e-7, 1e-3


#: Weights are kept in steps of 1/16, as one byte for each domain of a bucket, from 0 for -4 to 127.
STEPS, ZERO = 16, 64


@dataclass
class Membership:
    """Log priors of the domains, and the weights of significant buckets in the order of ``buckets``, in steps of 1/16."""

    priors: list[float]
    buckets: list[int]
    weights: list[list[float]]

    def table(self) -> bytearray:
        """The weights of all buckets, those of one bucket side by side."""
        out = np.full((FEATURES, len(DOMAINS)), ZERO, np.uint8)
        if self.buckets:
            out[self.buckets] = np.array(self.weights) * STEPS + ZERO
        return bytearray(out.tobytes())


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__n`` (number of tokens) and ``__features`` (buckets of distinct words and of shape marks, some perhaps twice)."""
    whole = F.coalesce(text, F.lit(""))
    df = df.withColumn("__words", F.split(F.lower(whole), r"[^\p{L}\p{N}]+"))  # the first and the last may be empty
    empty = lambda at: (F.element_at("__words", at) == "").cast("long")
    df = df.withColumn("__distinct", F.array_except("__words", F.array(F.lit("")))).withColumn("__n", F.size("__words") - F.when(F.size("__words") > 1, empty(1) + empty(-1)).otherwise(empty(1)))
    n = F.greatest(F.length(whole), F.lit(1))
    signs = F.length(F.regexp_replace(whole, r"[\p{L}\p{N}\s.,]+", ""))
    capitals = F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", ""))
    mark = lambda name, share: F.concat(F.lit(f"#{name} "), F.round(20 * share).cast("int").cast("string"))
    marks = F.array(mark("signs", signs / n), mark("capitals", capitals / n), mark("distinct", F.size("__distinct") / F.greatest(F.col("__n"), F.lit(1))))
    return df.withColumn("__features", F.transform(F.concat("__distinct", marks), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))).drop("__words", "__distinct")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Membership:
    """Learn from about ``sample`` labelled documents (all, if there are fewer): a fixed pseudo-random share of ids."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "high").otherwise("low")
    usable = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")).select("doc_id", domain.alias("domain"))
    n = usable.count()
    drawn = hash_fraction("doc_id", sample / max(n, 1), "mixing")
    # the label side is bounded by the sample, so it may be broadcast
    known = docs.select("doc_id", "text").where(drawn).join(F.broadcast(usable.where(drawn)), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    each = with_features(known).select("domain", F.explode(F.concat(F.array_distinct("__features"), F.array(F.lit(-1)))).alias("f"))  # -1 counts documents
    counts = each.groupBy("f").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS]).collect()  # FEATURES + 1 rows at most
    total = np.array(next(([r[d] for d in DOMAINS] for r in counts if r["f"] == -1), [0] * len(DOMAINS)), float)
    rows = sorted((r["f"], *(r[d] for d in DOMAINS)) for r in counts if r["f"] >= 0)
    inside = np.array([r[1:] for r in rows], float).reshape(-1, len(DOMAINS))
    seen, everything = inside.sum(axis=1, keepdims=True), max(total.sum(), 1)
    outside, rest, share = seen - inside, total.sum() - total, seen / everything
    # the half and the one keep a few documents from proving anything
    error = np.sqrt(total * share * (1 - share) * rest / everything + 1)
    w = np.log((inside + 0.5) / (total + 1)) - np.log((outside + 0.5) / (rest + 1))
    w = np.where((np.abs(inside - total * share) - 0.5) / error > SIGNIFICANT, w / SOFTNESS, 0.0)
    w = np.clip(np.round(w * STEPS), -ZERO, ZERO - 1) / STEPS
    some = np.flatnonzero((w != 0).any(axis=1))
    priors = [math.log((t + 1) / (total.sum() + len(DOMAINS))) for t in total]
    return Membership(priors, [rows[k][0] for k in some], w[some].tolist())


def members(docs: DataFrame, model: Membership) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``p_<domain>``; computed row by row, without a shuffle."""
    df = with_features(docs)
    z = [F.lit(p) for p in model.priors]
    if model.buckets:
        table, width = F.lit(model.table()), len(DOMAINS)
        df = df.withColumn("__met", F.array_intersect("__features", F.from_json(F.lit(json.dumps(model.buckets)), "array<int>")))
        step = lambda k: lambda total, f: total + F.ascii(F.substring(table, f * width + (k + 1), F.lit(1)).cast("string"))
        z = [p + (F.aggregate("__met", F.lit(0), step(k)) - ZERO * F.size("__met")) / float(STEPS) for k, p in enumerate(z)]
    df = df.withColumns({f"__z{k}": c for k, c in enumerate(z)})
    top = F.greatest(*[F.col(f"__z{k}") for k in range(len(DOMAINS))])
    df = df.withColumns({f"__e{k}": F.exp(F.col(f"__z{k}") - top) for k in range(len(DOMAINS))})
    whole = sum((F.col(f"__e{k}") for k in range(len(DOMAINS))), F.lit(0.0))
    own = [c for c in docs.columns if c != "n_tokens" and c not in {f"p_{d}" for d in DOMAINS}]
    return df.select(*[F.col(f"`{c}`") for c in own], F.col("__n").alias("n_tokens"), *[(F.col(f"__e{k}") / whole).alias(f"p_{d}") for k, d in enumerate(DOMAINS)])


def rate(move: list[float]) -> Column:
    """A document's rate: one copy, moved and projected."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{d}") * F.lit(float(x)) for d, x in zip(DOMAINS, move, strict=True)), F.lit(0.0)))


def fit_rates(table: DataFrame, targets: list[float], pull: float = PULL, tolerance: float = 1e-9, most_steps: int = 200) -> tuple[list[float], float]:
    """``move`` for ``rate``, and the distance that is left between expected and wanted shares of all tokens.

    ``table`` (n_tokens, p_<domain>) is read once for each step, so it should be materialised. The steps descend on
    the squared distance plus ``pull`` x the rates' squared distance from one; a step that doesn't is halved. The least is reached
    where the scaled gradient vanishes; not to reach it in ``most_steps`` is an error.
    """
    k, w = len(targets), F.col("n_tokens").cast("double")
    p = [F.col(f"p_{d}") for d in DOMAINS]
    total = table.agg(F.sum(w)).first()[0]
    wanted, pulled = np.array(targets), pull * np.eye(k)
    if not total:
        return [0.0] * k, float(np.linalg.norm(wanted))

    def at(move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        r = rate(move.tolist())
        open_ = w * (r > 0).cast("double")
        row = table.agg(*[F.sum(w * r * p[i]).alias(f"e{i}") for i in range(k)], *[F.sum(open_ * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], F.sum(w * r * r).alias("rr")).first()
        gap = np.array([row[f"e{i}"] for i in range(k)]) / total - wanted
        moments = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
        # its gradient is minus what is left to do: the dual of the least squares problem
        height = 0.5 * row["rr"] / total + move @ wanted + 0.5 * move @ pulled @ move
        return gap, moments, height

    move = np.zeros(k)
    gap, moments, height = at(move)
    for _ in range(most_steps):
        left = gap - pulled @ move
        if np.abs(left).max() < tolerance:
            break
        step = np.linalg.solve(moments + pulled, left)
        size = 1.0
        while True:
            new = move + size * step
            gap, moments, lower = at(new)
            if lower <= height - 1e-4 * size * float(left @ step) or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:  # as far as double precision goes
            break
        move, height = new, lower
    else:
        raise RuntimeError("the rates did not settle")
    gap, *_ = at(move)
    return move.tolist(), float(np.linalg.norm(gap))


def copies(rate_: Column, key: Column) -> Column:
    """Whole copies with the rate as their expectation; the rounding is a hash of the row, so a retry repeats it."""
    u = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate_ + u).cast("int")


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], pull: float) -> tuple[DataFrame, list[float], float, Membership]:
    """(doc_id, key, n_tokens, p_<domain>) of every row, the rates' ``move``, the distance left, and the classifier."""
    model = fit(docs, labels)
    table = checkpointed(members(spread(docs.select("doc_id", "text")), model).withColumn("key", F.xxhash64("doc_id", "text")).drop("text"))
    move, residual = fit_rates(table, [targets[d] for d in DOMAINS], pull)
    return table, move, residual, model


def plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, pull: float = PULL) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>, rate, copies, residual) of every row; ``targets``: each domain's wanted tokens, as shares of all tokens there are."""
    table, move, residual, _ = fitted(docs, labels, targets, pull)
    out = table.withColumn("rate", rate(move))
    return out.withColumn("copies", copies(F.col("rate"), F.col("key"))).withColumn("residual", F.lit(residual)).drop("key")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, pull: float = PULL) -> DataFrame:
    """``docs``, each row as often as its copies say. Probabilities are computed again beside the text, so no text is shuffled."""
    _, move, _, model = fitted(docs, labels, targets, pull)
    inner = spread(docs).select("doc_id", "text", F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    chosen = members(inner, model).withColumn("__copies", copies(rate(move), F.xxhash64("doc_id", "text")))
    # no filter on copies: pushed down, it would compute everything twice
    return chosen.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Domain probabilities, rate and copies of every document, and the distance left from the targets."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return plan(read("documents").select("doc_id", "text"), read("labels"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, which may be never: the targets are fixed shares of all tokens that came in."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), STAGE_TARGETS, STAGE_PULL)

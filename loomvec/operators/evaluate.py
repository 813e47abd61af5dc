"""Neighbour recall of an adapted space, and the gate it must pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.functions.vectors import nearest


class AdapterQualityError(RuntimeError):
    def __init__(self, arr: float, threshold: float):
        super().__init__(f"adapter recall {arr:.4f} is below {threshold:.4f}: re-embed with the dual-write strategy instead")
        self.arr, self.threshold = arr, threshold


def overlap(expected: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of each query's expected ids (query_id, id) that were found."""
    hit = expected.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / k).alias("recall"))


def adapted_recall(old: DataFrame, adapted: DataFrame, k: int = 10) -> DataFrame:
    """One row ``arr``: mean recall of the old space's neighbours when searching it with adapted vectors (id, vector), self excluded."""
    return overlap(nearest(old, old, k), nearest(adapted, old, k), k).agg(F.avg("recall").alias("arr"))


def check(old: DataFrame, adapted: DataFrame, k: int = 10, threshold: float | None = 0.97) -> float:
    """The recall; raises if it is below ``threshold``."""
    n = old.count()
    if k >= n:
        raise ValueError(f"k={k} needs more than {n} vectors")
    if adapted.count() != n:
        raise ValueError("both spaces must hold the same vectors")
    arr = float(adapted_recall(old, adapted, k).first()["arr"])
    if threshold is not None and arr < threshold:
        raise AdapterQualityError(arr, threshold)
    return arr


def hash_share(key: str | Column, salt: str | Column) -> Column:
    """A number from 0 to 1 for each key, the same at every run: the first 32 bits of an MD5 of salt and key."""
    key, salt = (F.col(c) if isinstance(c, str) else c for c in (key, salt))
    return F.conv(F.substring(F.md5(F.concat(salt.cast("string"), F.lit(":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def assigned(queries: DataFrame, share: float = 0.5, key: str = "id", salt: str = "arm") -> DataFrame:
    """``queries`` with ``arm``: ``new`` for a share of them, else ``old``. A query has the same arm whenever it comes, and a larger share only moves some from old to new."""
    return queries.withColumn("arm", F.when(hash_share(key, F.lit(salt)) < share, "new").otherwise("old"))


def poisson(u: Column, most: int = 12) -> Column:
    """A Poisson number of mean 1 from a number between 0 and 1; beyond ``most`` there is less than one in 10^10."""
    out, below = F.lit(0), 0.0
    for k in range(most):
        below += math.exp(-1) / math.factorial(k)
        out = out + (u >= below).cast("int")
    return out


def split_delta(scores: DataFrame, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """One row: how much better the new arm's queries fare than the old one's, and an interval for it.

    ``scores``: query_id, arm, recall. Each round of the bootstrap counts each query a Poisson number of times, drawn from its id and the round, so
    all rounds are one aggregate, no rows are drawn anywhere, and a retried task counts the same. Without queries in an arm the difference is null.
    """
    drawn = scores.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    # round 0 is the sample itself
    weight = F.when(F.col("round") == 0, 1).otherwise(poisson(hash_share("query_id", F.col("round"))))
    arm = lambda a: F.try_divide(F.sum(F.when(F.col("arm") == a, F.col("recall") * weight)), F.sum(F.when(F.col("arm") == a, weight)))
    n = lambda a: F.count_if((F.col("arm") == a) & (F.col("round") == 0))
    by_round = drawn.groupBy("round").agg(arm("old").alias("old"), arm("new").alias("new"), n("old").alias("n_old"), n("new").alias("n_new"))  # rounds + 1 rows
    gap, own = F.col("new") - F.col("old"), F.col("round") == 0
    side = (1 - level) / 2
    ends = F.percentile(F.when(~own, gap), F.array(F.lit(side), F.lit(1 - side)))
    only = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    out = by_round.agg(only("n_old"), only("n_new"), only("old"), only("new"), F.max(F.when(own, gap)).alias("delta"), ends.alias("ends"))
    return out.select("n_old", "n_new", F.col("old").alias("recall_old"), F.col("new").alias("recall_new"), "delta", F.col("ends")[0].alias("delta_low"), F.col("ends")[1].alias("delta_high"))


def split_traffic(queries: DataFrame, truth: DataFrame, old: DataFrame, new: DataFrame, k: int = 10, share: float = 0.5, rounds: int = 200, level: float = 0.95, search=nearest) -> DataFrame:
    """Each query (id, vector_old, vector_new) goes to one of two collections (id, vector), as its arm says, and ``split_delta`` compares what they find of ``truth`` (query_id, id)."""
    split = assigned(queries, share)
    scores = []
    for arm, base, vector in (("old", old, "vector_old"), ("new", new, "vector_new")):
        own = split.where(F.col("arm") == arm).select("id", F.col(vector).alias("vector"))
        wanted = truth.join(own.select(F.col("id").alias("query_id")), "query_id", "left_semi")
        scores.append(overlap(wanted, search(own, base, k), k).withColumn("arm", F.lit(arm)))
    return split_delta(scores[0].unionByName(scores[1]), rounds, level)


def recall_delta(truth: DataFrame, first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """One row: mean recall of two result lists (query_id, id) against the same truth, and their difference."""
    mean = lambda found, name: overlap(truth, found, k).agg(F.avg("recall").alias(name))
    return mean(first, "recall_old").join(mean(second, "recall_new")).withColumn("delta", F.col("recall_new") - F.col("recall_old"))

"""Mixing to target weights: soft domain membership, and document rates fitted by projected gradient least squares.

A multinomial logistic regression over hashed words, learnt from a labelled table, gives each document posteriors p over
domains. Every document has a rate r >= 0 of its own; the rates minimise

    sum over domains k of (T_k(r) - t_k)^2 / s_k  +  NEARNESS x sum over documents of w (r - 1)^2,

w a document's share of all tokens, T_k(r) = sum over documents of w r p_k the share that domain k is then expected to have,
t_k its target, and s_k the larger of t_k and FLOOR. The second term, small beside the first, chooses among all rates that
fit alike those nearest to 1. With g_k = (T_k - t_k) / s_k, a projected gradient step of pace 1 / NEARNESS leads from any
rates to

    r = max(0, 1 - sum over k of p_k y_k),      y = g / NEARNESS

(held to `most` too, if that is asked for). So all rates follow from y, one number a domain, and at the minimum the step
leads back to the rates that it starts from. That fixed point is where a convex function of y is least; each pass over the
documents brings back its value, its gradient (the T_k) and its curvature (sums of w p_k p_l over rates that aren't held),
Newton's step, halved where the function wouldn't fall, leads to the next, and the fit ends when the projected gradient step moves no y by
more than NEAR of the largest. A document is then taken floor(r) times, and once more by a draw of probability r - floor(r)
that its id decides. Over documents only DataFrame functions and Spark ML's own transformers run.
"""

from __future__ import annotations

from functools import reduce
from math import inf, isfinite
from operator import add

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import free_name, written

#: Shares of tokens by domain: languages, and texts labelled as poor.
TARGETS = {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10, "poor": 0.0}
#: SAMPLE: labelled documents that the classifier is fitted on, at most about so many, chosen by a hash of their ids.
SAMPLE, BUCKETS, PENALTY, ROUNDS = 4000, 1 << 14, 1e-4, 30
#: NEARNESS: the weight of rates near 1; NEAR: where the fit ends; FLOOR: least weight of a target.
NEARNESS, NEAR, FLOOR, MOST = 0.01, 1e-6, 0.1, inf
#: Passes after which a fit that hasn't ended is an error: it ends in about ten.
PASSES = 200


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(split, lambda w: w != "")


def _features(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two columns: the words of each whole text, and their hashed counts as a vector of length 1."""
    w, counts = free_name(docs, "words"), free_name(docs, "counts")
    told = HashingTF(numFeatures=BUCKETS, inputCol=w, outputCol=counts).transform(docs.withColumn(w, words(F.col(f"`{text_col}`"))))
    unit = free_name(told, "unit")
    return Normalizer(p=2.0, inputCol=counts, outputCol=unit).transform(told).drop(counts), w, unit


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> LogisticRegressionModel | list[float]:
    """A classifier of documents into domains, or fixed posteriors where the labels name one domain only, or none."""
    known = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = written(known)
    counts = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    if len(counts) < 2:
        return [1.0 / len(domains) if not counts else float(k in counts) for k in domains]
    share = min(1.0, sample / sum(counts.values()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")  # SAMPLE rows
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    rows, _, unit = _features(own.withColumn("label", place.cast("double")))
    logistic = LogisticRegression(family="multinomial", featuresCol=unit, regParam=PENALTY, maxIter=ROUNDS, standardization=False)
    return logistic.fit(written(rows.select("label", unit)).coalesce(4))  # SAMPLE rows, read in every round


def with_posteriors(docs: DataFrame, model: LogisticRegressionModel | list[float], domains: list[str], tokens: str, soft: str) -> DataFrame:
    """docs with the number of each text's words, and an array of the probabilities of the domains in their order."""
    told, w, unit = _features(docs)
    told = told.withColumn(tokens, F.size(w).cast("long"))
    if isinstance(model, list):
        return told.withColumn(soft, F.array(*map(F.lit, model))).drop(w, unit)
    p = free_name(told, "probability")
    told = model.copy().setFeaturesCol(unit).setProbabilityCol(p).setRawPredictionCol("").setPredictionCol("").transform(told)
    rest = F.array_repeat(F.lit(0.0), len(domains) - model.numClasses)
    return told.withColumn(soft, F.concat(vector_to_array(p), rest)).drop(w, unit, p)


def _inner(soft: Column, y: list[float]) -> Column:
    return reduce(add, [soft[k] * v for k, v in enumerate(y)])


def rate(soft: Column, y: list[float], most: float = MOST) -> Column:
    """The rate that y gives to a document of these posteriors."""
    r = F.greatest(1.0 - _inner(soft, y), F.lit(0.0)) if y else F.lit(1.0)
    return F.least(r, F.lit(most)) if isfinite(most) else r


def fit(rows: DataFrame, targets: dict[str, float], most: float = MOST, nearness: float = NEARNESS, near: float = NEAR) -> list[float]:
    """y of the least squares over rows(n, soft), tokens and posteriors of each document; no numbers if there are no tokens."""
    whole = sum(targets.values())
    if not targets or min(targets.values()) < 0 or whole <= 0:
        raise ValueError("targets must be nonnegative and some of them positive")
    want = np.array([w / whole for w in targets.values()])
    scale = nearness * np.maximum(want, FLOOR)
    ks = range(len(want))
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    p = F.col("soft")

    def look(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The function's value at y, the shares of the domains, and the curvature."""
        free = rows.select("n", "soft", (1.0 - _inner(p, y.tolist())).alias("z"))
        r = F.greatest(F.least("z", F.lit(most)) if isfinite(most) else F.col("z"), F.lit(0.0))
        free = free.select("soft", "z", r.alias("r"), (F.col("n") * r).alias("m"), F.when((F.col("z") > 0) & (F.col("z") < F.lit(most)), F.col("n")).otherwise(0).alias("bent"))
        shares = [F.sum(F.col("m") * p[k]) for k in ks]
        curve = [F.sum(F.col("bent") * p[k] * p[j]) for k in ks for j in ks if j <= k]
        held, *row = (x / total for x in free.agg(F.sum(F.col("m") * (F.col("z") - 0.5 * F.col("r"))), *shares, *curve).first())
        bend = np.zeros((len(want), len(want)))
        bend[np.tril_indices(len(want))] = row[len(want) :]
        return held + float(want @ y) + 0.5 * float(scale @ (y * y)), np.array(row[: len(want)]), bend + np.tril(bend, -1).T

    y = np.zeros(len(want))
    value, shares, bend = look(y)
    for _ in range(PASSES):
        slope = scale * y - (shares - want)
        if np.abs(slope / scale).max() <= near * max(1.0, np.abs(y).max()):
            return y.tolist()
        step = -np.linalg.solve(bend + np.diag(scale), slope)
        now = look(y + step)
        while now[0] > value + 1e-4 * float(slope @ step) + 1e-12 * abs(value):
            step = step / 2
            now = look(y + step)
        y, (value, shares, bend) = y + step, now
    raise RuntimeError("the rates didn't settle")


def copies(r: Column, *key: Column) -> Column:
    """How often a document is taken: the draw comes from a hash of its key."""
    draw = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(r) + (draw < r - F.floor(r)).cast("int")).cast("int")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: a labelled document's language, or `poor` by its quality label."""
    own = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    both = docs.select("doc_id", "lang").join(own, "doc_id")
    return both.select("doc_id", F.when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, F.col("lang")).alias("domain"))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, most: float = MOST) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate, copies of every row of docs(doc_id, text).

    labelled: (doc_id, domain), of which domains outside the targets are left out, and the first counts if a document
    has several. Texts that are null or empty have no tokens, don't count in the fit, and get a rate like others; equal
    rows get the same rate and draw; ties between domains go to the first; other columns are left out. Without labels
    posteriors are even; without tokens all rates are 1.
    """
    domains = list(targets)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(with_posteriors(own, learn(own, labelled, domains), domains, "n", "soft").select("doc_id", "n", "soft"))
    p, names = F.col("soft"), F.array(*map(F.lit, domains))
    told = rows.withColumn("rate", F.round(rate(p, fit(rows, targets, most), most), 9))
    return told.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        names[F.array_position(p, F.array_max(p)).cast("int") - 1].alias("domain"),
        "rate",
        copies(F.col("rate"), F.col("doc_id"), F.col("n")).alias("copies"),
    )


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as its rate and draw say, with their own columns."""
    domains = list(targets)
    n, soft, times = (free_name(docs, c) for c in ("n", "soft", "times"))
    told = written(with_posteriors(docs, learn(docs, labelled, domains), domains, n, soft))
    y = fit(told.select(F.col(n).alias("n"), F.col(soft).alias("soft")), targets, most)
    r = F.round(rate(F.col(soft), y, most), 9)
    told = told.withColumn(times, copies(r, F.col("doc_id").cast("long"), F.col(n)))
    again = told.where(F.col(times) > 0).withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(times))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))

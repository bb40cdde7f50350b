"""Toxicity: cumulative-link ordinal regression on sparse text features, one weight vector under ordered thresholds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import saved
from .quality import SAMPLE_ROWS, held_out, training_rows

#: Probability from which a document counts as toxic; grades above 0; the share of toxic training documents (FEW at least) that a feature must be in; the times as common
#: there as elsewhere that makes it a feature, or a telling one; and the lengths of word beginnings that are features too.
TOXIC_FROM = 0.3
GRADES, SHARE, FEW, LEANING, TELLING, BEGINNINGS = 3, 0.005, 5, 2.0, 8.0, (4, 5, 6)

_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """The different words of a whole text, lower-cased, and beginnings of words, as sorted 64-bit hashes."""
    words = set(_WORD.findall((text or "").lower()))
    for n in BEGINNINGS:
        words |= {w[:n] + "*" for w in words if len(w) >= n and w[-1] != "*"}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(w) for w in words], np.uint64).view(np.int64))


@F.pandas_udf(ArrayType(LongType()))
def features_of(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w . x - thresholds[k])."""

    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) [rows, thresholds]."""
        sums = np.zeros(len(rows))
        sizes = np.array([len(r) for r in rows])
        if len(self.vocabulary) and sizes.sum():
            flat = np.concatenate(rows)
            at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
            value = np.where(self.vocabulary[at] == flat, self.weights[at], 0.0)
            sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), value, len(rows))
        return _sigmoid(sums[:, None] - self.thresholds)


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, vocabulary: np.ndarray, sparse: float = 5e-5, rounds: int = 300) -> Ordinal:
    """Maximum likelihood with an L1 penalty, by proximal gradient steps with momentum.

    The likelihood of a grade is the difference of two neighbouring cumulative probabilities. Thresholds are kept in order.
    """
    n, top = len(rows), int(grade.max(initial=0))
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if n and sizes.sum() else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    row, col = np.repeat(np.arange(n), sizes)[hit], at[hit]
    over = np.array([(grade > k).mean() if n else 0.5 for k in range(max(1, top))])
    cut = -np.log(np.clip(over, 1e-6, 1 - 1e-6) / (1 - np.clip(over, 1e-6, 1 - 1e-6)))
    w = np.zeros(len(vocabulary))
    if not top or not len(vocabulary):
        return Ordinal(vocabulary, w, cut)
    each = np.bincount(col, minlength=len(vocabulary))
    step = 1.0 / np.sqrt(1.0 + each)  # frequent words move less
    state = [np.zeros_like(w), np.zeros_like(cut)]
    for _ in range(rounds):
        z = np.bincount(row, w[col], n)
        p = _sigmoid(z[:, None] - cut)
        ends = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        mass = np.maximum(ends[i, grade] - ends[i, grade + 1], 1e-12)
        pull = (slope[i, grade] - slope[i, grade + 1]) / mass  # of the log likelihood on z
        gw = np.bincount(col, pull[row], len(w)) * step
        gc = np.array([-(np.where(grade == k + 1, slope[i, k + 1], 0) - np.where(grade == k, slope[i, k + 1], 0)).dot(1 / mass) for k in range(top)]) / n
        state = [0.8 * state[0] + 0.2 * gw, 0.8 * state[1] + gc]
        w = w + 0.5 * step * state[0]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * step**2 * sparse * n, 0)
        cut = np.maximum.accumulate(cut + 0.5 * state[1])
    keep = w != 0
    return Ordinal(vocabulary[keep], w[keep], cut)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, grades: int = GRADES) -> Ordinal:
    """Fit on a bounded sample of labelled documents, each different set of features once per label.

    Labels say toxic or not. Severity grades 1 to `grades` are made from them: a toxic document's grade rises with how
    many different telling features it has, cut at quantiles of the toxic documents. So severity only ranks documents by
    the amount of evidence; P(toxic), the first threshold, is fitted on the given label. Spark counts the documents of each
    feature; to the driver come the counts of features that a share of the toxic ones have, and then each document's
    features among those that lean to toxic ones.
    """
    sample = training_rows(docs, labels, "toxic", features_of(F.col("text")), most)
    sample = saved(sample.select((F.col("y") > 0).alias("toxic"), "x", F.xxhash64("x").alias("h")).dropDuplicates(["h", "toxic"]))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def among(words: np.ndarray) -> DataFrame:
        @F.pandas_udf(ArrayType(LongType()))
        def cut(x: pd.Series) -> pd.Series:
            return pd.Series([np.intersect1d(np.asarray(r, np.int64), words, assume_unique=True) for r in x])

        return sample.select("toxic", "h", cut("x").alias("x"))

    often = sample.filter("toxic").select(F.explode("x").alias("w")).groupBy("w").count().filter(F.col("count") >= max(FEW, SHARE * n.get(True, 0)))
    words = np.sort(often.select("w").toPandas()["w"].to_numpy(np.int64))
    counts = among(words).select("toxic", F.explode("x").alias("w")).groupBy("w").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).orderBy("w").toPandas()
    lean = ((counts["t"] + 0.5) / max(1, n.get(True, 0)) / ((counts["c"] + 0.5) / max(1, n.get(False, 0)))).to_numpy(np.float64)
    words, lean = counts["w"].to_numpy(np.int64)[lean >= LEANING], lean[lean >= LEANING]
    table = among(words).orderBy("h", "toxic").toPandas()
    toxic, rows = table["toxic"].to_numpy(bool), [np.asarray(x, np.int64) for x in table["x"]]
    strength = np.array([np.isin(r, words[lean >= TELLING]).sum() for r in rows], np.int64)
    cuts = np.quantile(strength[toxic], np.arange(1, grades) / grades, method="higher") if toxic.any() else np.zeros(0)
    grade = np.where(toxic, 1 + (strength[:, None] > np.unique(cuts)).sum(axis=1), 0).astype(np.int64)
    return fit_ordinal(rows, np.searchsorted(np.unique(grade), grade), words)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, p_toxic, severity (the expected grade), toxic (1 if p_toxic >= TOXIC_FROM, else 0).

    Whole texts are read; null and empty ones have no features and get the base rate. Rows without an id are scored and
    aren't held out; repeated rows are scored each; without labels of both kinds nothing is toxic; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, most)

    @F.pandas_udf(StructType([StructField("p_toxic", DoubleType()), StructField("severity", DoubleType())]))
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            p = model.above([features(t) for t in s])
            yield pd.DataFrame({"p_toxic": p[:, 0], "severity": p.sum(axis=1)})

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("s")).select("doc_id", "held_out", "s.*")
    return out.withColumn("toxic", (F.col("p_toxic") >= TOXIC_FROM).cast("int"))

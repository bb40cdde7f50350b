"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import saved, text_batches

#: Labelled rows that a fit takes at most, those with the smallest hashes. Documented bound: the fit runs on the driver.
SAMPLE_ROWS, SEED = 20_000, 42
#: Score below which a document is rejected.
REJECT_BELOW = 0.3

STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "space", "punctuation", "not_ascii", "entropy", "distinct_words", "top_word",
    "distinct_triples", "repeated_word", "distinct_lines", "log_mean_line", "short_lines", "capital_words", "odd_ends", "odd_words", "sentences",
)


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text; a null or empty one has zeros. Neither language, source nor id enter."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    n, m = len(raw), len(words)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = c[c > 0] / n
    symbols = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    count = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    lengths = [len(s) for s in lines]
    return [
        math.log1p(n), math.log1p(m), len(text) / m, int(c[65:91].sum()) / n, int(c[48:58].sum()) / n, int(c[9:14].sum() + c[32]) / n, symbols / n,
        int(c[128:].sum()) / n, float(-(p * np.log(p)).sum()), len(count) / m, max(count.values()) / m, len(set(zip(words, words[1:], words[2:]))) / max(1, m - 2),
        sum(map(str.__eq__, words, words[1:])) / m, len(set(lines)) / max(1, len(lines)), math.log1p(sum(lengths) / max(1, len(lines))),
        sum(k < 30 for k in lengths) / max(1, len(lines)), sum(map(str.istitle, words)) / m, sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in words) / m,
        sum(not any(map(str.isalnum, w)) for w in words) / m, sum(w[-1] in ".?!" for w in words) / m,
    ]


@F.pandas_udf(ArrayType(FloatType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([np.array(statistics(t), np.float32) for t in texts])


@dataclass
class Trees:
    """Boosted complete trees as arrays: node i of a tree has its children at 2i + 1 and 2i + 2; `leaf` holds the last level."""

    feature: np.ndarray  # [trees, nodes]
    cut: np.ndarray  # [trees, nodes]: a value above it goes right
    leaf: np.ndarray  # [trees, leaves]
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows and trees a level at a time."""
        out = np.full(len(x), self.start)
        trees = np.arange(len(self.feature))
        depth = int(math.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            out[i : i + 2048] += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Gradient boosting on the logistic loss; each level's splits come from histograms over quantile bins.

    One class only, or no rows, gives no trees and the share of label 1 (0.5 without rows) as every score.
    """
    share = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6))
    nodes, leaves, f = (1 << depth) - 1, 1 << depth, x.shape[1]
    start = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.float32), np.zeros((0, leaves)), start)
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0, method="lower").astype(np.float32)
    binned = np.stack([np.searchsorted(np.unique(cuts[:, j]), x[:, j], side="left") for j in range(f)], axis=1)
    steps = [np.unique(cuts[:, j]) for j in range(f)]
    features, limits, values = [], [], []
    margin = np.full(len(x), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf, np.float32)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            slot = (((node - first)[:, None] * f + np.arange(f)) * bins + binned).ravel()
            sums = [np.bincount(slot, np.repeat(w, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2) for w in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                j, k = divmod(b, bins)
                if gain[i, j, k] > 1e-9 and k < len(steps[j]):
                    feature[first + i], cut[first + i] = j, steps[j][k]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - nodes
        value = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += value[at]
        features.append(feature)
        limits.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), start)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by five. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, feature: Column, most: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, y, x) for at most `most` labelled documents that aren't held out, by hash of the id.

    A document without one clear label (null, or rows that differ) is no training row; of rows that repeat an id, the one
    whose text has the smallest hash is. Text isn't moved: the labels of the sample, bounded, are broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most"))
    known = known.filter("y = _most").select("doc_id", "y", F.xxhash64(F.lit(seed), "doc_id").alias("_h"))
    share = (most + 10 * most**0.5 + 100) / max(1, known.count())  # of all hashes, which holds `most` of them but for one case in 10**20
    near = known.filter(F.col("_h") < int(share * 2**64) - 2**63) if share < 1 else known  # so that few rows are ordered
    known = near.orderBy("_h", "doc_id").limit(most).drop("_h")
    rows = text_batches(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), feature.alias("x"))
    return saved(rows).groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("x", "h").alias("x"))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Trees:
    rows = training_rows(docs, labels, "quality", statistics_of(F.col("text")), most).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, rows["y"].to_numpy(np.float64))


def quality_score(model: Trees, text: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([statistics(t) for t in s], np.float32).reshape(len(s), len(STATISTICS))
            yield pd.Series(model.scores(x))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= REJECT_BELOW, else 0).

    Null and empty texts get the score of zero statistics. Rows without an id are scored and aren't held out; repeated
    rows are scored each; without usable labels every score is 0.5; an empty table gives no rows.
    """
    model = fit_quality(docs, labels, most)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that aren't rejected, with the columns of `docs`."""
    model = fit_quality(docs, labels, most)
    return docs.filter(quality_score(model, F.col("text")) >= REJECT_BELOW)
